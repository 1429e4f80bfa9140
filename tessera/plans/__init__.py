from tessera.plans.queries import QUERIES, table  # noqa: F401
from tessera.plans.oracle import ORACLE_SQL  # noqa: F401
