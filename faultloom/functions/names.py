"""Method, class, project and file names, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Source roots that precede a package, in the order they are cut.
SOURCE_ROOTS = ("src.java.main.", "src.main.java.", "src.java.")

# Source layouts by version prefix, and where their main and test code lies.
LAYOUT_RULES = (
    ("cassandra-%", "cassandra"), ("hadoop-0.21%", "hadoop021"), ("hadoop-0.23%", "hadoop023"), ("hadoop-1.%", "hadoop023"),
    ("hadoop-2.%", "hadoop023"), ("hbase-0.90%", "hbase90"), ("hbase-0.92%", "hbase90"), ("hbase-0.94%", "hbase90"),
    ("hbase-0.95%", "hbase95"), ("hbase-0.96%", "hbase95"), ("hbase-0.98%", "hbase95"),
)
DEFAULT_LAYOUT = "zookeeper"


def dotted(name: Column) -> Column:
    """Inner classes with a dot instead of ``$``."""
    return F.translate(name, "$", ".")


def after_last(name: Column, separator: str) -> Column:
    return F.substring_index(name, separator, -1)


def simple_key(method: Column) -> Column:
    """``Class#method``: what follows the last dot of the dotted name."""
    return after_last(dotted(method), ".")


def without_source_root(method: Column) -> Column:
    for root in SOURCE_ROOTS:
        method = F.substring_index(method, root, -1)
    return method


def signature_key(signature: Column) -> Column:
    """``a.C.m(List<A>, B)`` as ``a.C#m``."""
    bare = F.regexp_replace(F.regexp_replace(signature, r"<.*>", ""), r"\(.*\)", "")
    return F.regexp_replace(bare, r"^(.*)\.([^.]*)$", "$1#$2")


def test_label(label: Column) -> Column:
    return F.split_part(label, F.lit("@"), F.lit(1))


def system_of(version: Column) -> Column:
    return F.split_part(version, F.lit("-"), F.lit(1))


def report_id(file_name: Column) -> Column:
    return F.split_part(file_name, F.lit("_"), F.lit(1))


def project_of(version: Column) -> Column:
    """HDFS and MAPREDUCE versions belong to hadoop."""
    folded = F.startswith(version, F.lit("MAPREDUCE")) | F.startswith(version, F.lit("HDFS"))
    return F.when(folded, F.regexp_replace(version, "MAPREDUCE|HDFS", "hadoop")).otherwise(version)


def layout_of(version: Column) -> Column:
    out = F.lit(DEFAULT_LAYOUT)
    for pattern, layout in reversed(LAYOUT_RULES):
        out = F.when(F.like(version, F.lit(pattern)), F.lit(layout)).otherwise(out)
    return out


def truth_list(methods: Column) -> Column:
    """Comma-separated names, trimmed, less empty ones."""
    return F.filter(F.transform(F.split(methods, ","), lambda m: F.trim(m)), lambda m: m != "")
