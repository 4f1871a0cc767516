"""All queries of the mobility operators and their SQL equivalents."""

from skylane.plans import oracle, records_oracle
from skylane.plans.records import QUERIES

ORACLE_SQL = {**oracle.ORACLE_SQL, **records_oracle.ORACLE_SQL}

__all__ = ["ORACLE_SQL", "QUERIES"]
