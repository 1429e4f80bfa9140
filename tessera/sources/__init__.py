from tessera.sources.readers import *  # noqa: F401,F403
from tessera.sources.writers import *  # noqa: F401,F403
