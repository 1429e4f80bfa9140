from tessera.functions.scalars import *  # noqa: F401,F403
from tessera.functions.tensor import *  # noqa: F401,F403
