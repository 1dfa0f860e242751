"""carelens: clinical line lists, record investigation and audited corrections on Spark.

The library works on an electronic-medical-record schema (``obs`` entity-attribute-value rows plus
encounters, visits, identifiers and a concept dictionary). Every operator is DataFrame
code: joins, grouped aggregates and window functions that Catalyst plans and executors run.

Main entry points::

    from carelens import ClinicalTables, LineListParams, line_list
    t = ClinicalTables.read_parquet(spark, "/data/emr")
    df = line_list(spark, t, LineListParams(end=datetime.date(2024, 12, 25)))
"""

from carelens.plans.line_list import LineListParams, line_list, line_list_sections
from carelens.sources.tables import ClinicalTables

__all__ = ["ClinicalTables", "LineListParams", "line_list", "line_list_sections"]
__version__ = "0.1.0"
