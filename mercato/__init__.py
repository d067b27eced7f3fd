"""mercato: marketplace analytics reports as Spark DataFrame plans.

    from mercato.sources import load_tables
    from mercato.plans import REPORTS
    REPORTS["revenue_by_state"](load_tables(spark, path))
"""

__version__ = "0.1.0"
