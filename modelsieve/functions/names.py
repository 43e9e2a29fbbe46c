"""Column functions on object names and field references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODEL_SUFFIX = ".SemanticModel"
REPORT_SUFFIX = ".Report"

# Unicode white space and the ASCII separators, as a trimming class.
_SPACE = r"[\s\x{85}\x{A0}\x{1C}-\x{1F}\p{Z}]"


def strip(c: Column) -> Column:
    """Trim white space of any kind from both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(c, rf"^{_SPACE}+|{_SPACE}+$", "")


def safe_name(c: Column) -> Column:
    """File-system safe form of a display name.

    Everything that is not a letter, a digit, a blank, ``-`` or ``_`` becomes ``_``.
    """
    return F.regexp_replace(strip(c), r"[^\p{L}\p{N} _-]", "_")


def table_part(ref: Column) -> Column:
    """``Table`` of a ``Table.Field`` reference, null when the reference has no dot."""
    return F.when(F.instr(ref, ".") > 0, F.substring_index(ref, ".", 1))


def field_part(ref: Column) -> Column:
    """``Field`` of a ``Table.Field`` reference: everything after the first dot."""
    dot = F.instr(ref, ".")
    return F.when(dot > 0, F.substring(ref, dot + 1, F.length(ref)))


def model_name_of_report(report_name: Column) -> Column:
    """Name of the model a report belongs to by naming convention."""
    return F.concat(report_name, F.lit(MODEL_SUFFIX))
