"""Concept vocabulary, classes, tags and label lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Concept -> label.
CONCEPT_LABELS = {
    "307146003 |Sunday (qualifier value)|": "TIM",
    "1811000175105 |Every six hours as required (qualifier value)|": "TIM",
    "732936001 |Tablet (unit of presentation)|": "UNI",
    "1521000175104 |After dinner (qualifier value)|": "TIM",
    "34206005 |Subcutaneous route (qualifier value)|": "ROU",
    "26643006 |Oral route (qualifier value)|": "ROU",
    "54485002 |Ophthalmic route (qualifier value)|": "ROU",
    "6064005 |Topical route (qualifier value)|": "ROU",
    "258682000 |gram (qualifier value)|": "MEAS",
    "258798001 |Milligram/milliliter (qualifier value)|": "MEAS",
    "225758001 |After food (qualifier value)|": "TIM",
    "47625008 |Intravenous route (qualifier value)|": "ROU",
    "763158003 |Medicinal product (product)|": "MED",
    "1781000175108 |Every eight hours as required (qualifier value)|": "TIM",
    "732937005 |Capsule (unit of presentation)|": "UNI",
    "225761000 |As required (qualifier value)|": "TIM",
    "258685003 |microgram (qualifier value)|": "MEAS",
    "1791000175106 |Every four hours as required (qualifier value)|": "TIM",
    "415067009 |Percentage unit (qualifier value)|": "MEAS",
    "732997007 |Inhaler (unit of presentation)|": "UNI",
    "1287350009 |After breakfast (qualifier value)|": "TIM",
    "258773002 |Milliliter (qualifier value)|": "MEAS",
    "229798009 |Three times daily (qualifier value)|": "TIM",
    "20050000 |Biweekly (qualifier value)|": "TIM",
    "307155000 |Before sleeping (qualifier value)|": "TIM",
    "258705008 |week (qualifier value)|": "TIM",
    "37161004 |Rectal route (qualifier value)|": "ROU",
    "229799001 |Twice a day (qualifier value)|": "TIM",
    "396117002 |Monday through Friday (qualifier value)|": "TIM",
    "307151009 |Saturday (qualifier value)|": "TIM",
    "225757006 |Every four to six hours (qualifier value)|": "TIM",
    "733013000 |Sachet (unit of presentation)|": "UNI",
    "311503006 |With or after meal (qualifier value)|": "TIM",
    "307439001 |Four times daily (qualifier value)|": "TIM",
    "307145004 |Monday (qualifier value)|": "TIM",
    "418913000 |Arbitrary unit per milliliter (qualifier value)|": "MEAS",
    "733005001 |Patch (unit of presentation)|": "UNI",
    "307470009 |Every twelve hours (qualifier value)|": "TIM",
    "258766007 |Arbitrary unit (qualifier value)|": "MEAS",
    "732994000 |Drop (unit of presentation)|": "UNI",
    "225769003 |Once a week (qualifier value)|": "TIM",
    "307165006 |Before meal (qualifier value)|": "TIM",
    "229797004 |Once daily (qualifier value)|": "TIM",
    "732935002 |Unit of presentation (unit of presentation)|": "UNI",
    "307469008 |Every eight hours (qualifier value)|": "TIM",
    "24863003 |Postprandial (qualifier value)|": "TIM",
    "225756002 |Every four hours (qualifier value)|": "TIM",
    "18629005 |Administration of drug or medicament (procedure)|": "PRO",
    "RTIM": "RTIM",
}

# Label -> parent concept; every concept of a label has the same parent.
LABEL_PARENTS = {
    "TIM": "272103003 |Time patterns (qualifier value)|",
    "UNI": "732935002 |Unit of presentation (unit of presentation)|",
    "ROU": "284009009 |Route of administration value (qualifier value)|",
    "MEAS": "767524001 |Unit of measure (qualifier value)|",
    "MED": "763158003 |Medicinal product (product)|",
    "PRO": "18629005 |Administration of drug or medicament (procedure)|",
    "RTIM": "RTIM",
}

# The procedure concept is in the maps but not in the plain concept list.
CONCEPT_LIST_EXCLUDES = ("18629005 |Administration of drug or medicament (procedure)|",)

# Labels of numeric and of unmapped concepts.
NUMBER_LABEL = "DEC"
DEFAULT_LABEL = "SUB"

# Entity classes and the outside tag.
CLASSES = ("MED", "PRO", "UNI", "SUB", "TIM", "DEC", "ROU", "MEAS", "RTIM")
OUTSIDE = "O"
TAGS = tuple(f"{p}-{c}" for c in CLASSES for p in "BI") + (OUTSIDE,)

# Tag and class lists of the score tables.
SCORED_TAGS = ("O", "B-SUB", "B-DEC", "B-ROU", "B-TIM", "B-UNI", "I-ROU", "I-TIM", "I-SUB",
               "B-MEAS", "B-RTIM")
SCORED_CLASSES = ("SUB", "DEC", "ROU", "TIM", "UNI", "MEAS", "RTIM")

# Tags whose prefix the ``listed`` strip mode removes.
LISTED_STRIP = ("B-SUB", "B-DEC", "B-ROU", "B-TIM", "B-UNI", "I-ROU", "I-TIM", "I-SUB",
                "B-MEAS", "B-RTIM")

# Display names of predicted and of gold tags.
DISPLAY_PRED = {"B-SUB": "B-BSUB", "B-DEC": "B-BDEC", "B-ROU": "B-BROU", "B-TIM": "B-BTIM",
                "B-UNI": "B-BUNI", "I-TIM": "I-ITIM", "I-SUB": "I-ISUB"}
DISPLAY_GOLD = {"B-SUB": "B-BSUB", "B-DEC": "B-BDEC", "B-ROU": "B-BROU", "B-TIM": "B-BTIM",
                "B-UNI": "B-BUNI", "I-ROU": "I-IROU", "I-TIM": "I-ITIM", "I-SUB": "I-ISUB",
                "B-MEAS": "B-BMEAS", "B-RTIM": "B-RTIM"}

# Type endings that merge into one entity, and the label repaired afterwards.
RUN_SUFFIXES = ("TIM", "SUB", "ROU", "UNI", "MEAS", "DEC", "RTIM")
REPAIR_FROM, REPAIR_TO = "EAS", "MEA"

# Grades and grading modes.
GRADES = ("COR", "INC", "PAR", "MIS", "SPU")
MODES = ("type", "partial", "exact", "strict")


def literal(value: str | None) -> str:
    """A SQL string literal."""
    if value is None:
        return "cast(null as string)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_array(values) -> Column:
    """A constant string array, built in one call."""
    return F.expr(f"array({', '.join(map(literal, values))})")


def _literal_rows(spark: SparkSession, names: tuple[str, ...], rows) -> DataFrame:
    """A constant table that lives in the plan (no data shipped by Python workers)."""
    values = ", ".join(f"({', '.join(map(literal, row))})" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(f'`{n}`' for n in names)})")


def concept_table(spark: SparkSession) -> DataFrame:
    """``concept, label, parent``; 49 rows, one ``is_a`` edge each."""
    return _literal_rows(spark, ("concept", "label", "parent"),
                         [(c, l, LABEL_PARENTS[l]) for c, l in CONCEPT_LABELS.items()])


def concept_list(spark: SparkSession) -> DataFrame:
    """``concept``; the 48 listed concepts."""
    return _literal_rows(spark, ("concept",),
                         [(c,) for c in CONCEPT_LABELS if c not in CONCEPT_LIST_EXCLUDES])


def tag_set(spark: SparkSession, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """``tag, prefix, class``: every class with B- and I-, and the outside tag."""
    rows = [(f"{p}-{c}", p, c) for c in classes for p in "BI"] + [(OUTSIDE, None, None)]
    return _literal_rows(spark, ("tag", "prefix", "class"), rows)
