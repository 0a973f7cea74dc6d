"""Typed schemas of the property graph, node and edge enums, id packing and the range codec."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Node types by number, fixed values of the data model.
NODE_TYPES = {"ModuleScope": 1, "FileScope": 2, "Block": 3, "Variable": 4, "Expression": 5, "Conditional": 6, "Function": 7, "Class": 8, "Field": 9, "FunctionCall": 10, "FileNumber": 11, "Loop": 12, "Import": 13}
EDGE_LABELS = ("CONTAINS", "HAS_FIELD", "CALLS", "CALLS_FUNCTION", "INHERITS", "FUNCTION_ARG", "FUNCTION_CALL_ARG", "BODY", "BRANCH", "DATA_FLOW", "THIS", "USES_VARIABLE", "IMPORTS", "ANNOTATION", "FROM", "RETURNS", "ALIAS")
LEVELS = {"function": 1, "class": 2, "file": 3, "folder": 4, "project": 5}

NODES = "id long, node_type int, file_id int, name string, sl int, sc int, el int, ec int, is_constructor boolean, fake boolean, md map<string,string>, extends array<string>, implements array<string>, annotations array<string>"
EDGES = "src long, dst long, label string, position int"


def node_id(file_id: Column, seq: Column) -> Column:
    """Surrogate ids hold the file in the upper 32 bits; a file's own node has the file id."""
    return F.shiftleft(file_id.cast("long"), 32) + seq


def file_of(node: Column) -> Column:
    return F.when(node < F.lit(1 << 32), node).otherwise(F.shiftright(node, 32)).cast("int")


def label_of_type(t: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for n, i in NODE_TYPES.items() for x in (i, n)]), t.cast("int"))


def range_text(sl: Column, sc: Column, el: Column, ec: Column) -> Column:
    return F.format_string("(%d,%d)-(%d,%d)", sl, sc, el, ec)


def range_part(text: Column, part: int) -> Column:
    """1..4 = start line, start column, end line, end column; null if the text is no range."""
    return F.expr("1").cast("int") * F.nullif(F.regexp_extract(text, r"^\((\d+),(\d+)\)-\((\d+),(\d+)\)$", part), F.lit("")).cast("int")


def in_range(line: Column, ch: Column, sl: Column, sc: Column, el: Column, ec: Column) -> Column:
    """Closed, line-major: whether a point lies in a range."""
    at = F.struct(line.alias("l"), ch.alias("c"))
    return (at >= F.struct(sl.alias("l"), sc.alias("c"))) & (at <= F.struct(el.alias("l"), ec.alias("c")))


def range_in_range(inner: tuple[Column, Column, Column, Column], outer: tuple[Column, Column, Column, Column]) -> Column:
    """Closed, line-major: whether the first range lies in the second."""
    return in_range(inner[0], inner[1], *outer) & in_range(inner[2], inner[3], *outer)
