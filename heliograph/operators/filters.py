"""The filter language: a tree of conditions that becomes one Column, and the catalogue's filter specification."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.functions.paths import normalised, parent

OPS = ("eq", "ne", "contains", "not_contains", "gt", "lt", "ge", "le", "starts", "ends", "between", "regex")
TEXT_OPS = ("contains", "not_contains", "starts", "ends", "regex")

#: The catalogue's fields by the names that filters use.
FIELDS = {
    "name": "displayName", "extension": "fileExtension", "path": "sleevePath", "rating": "rating", "flag": "flag", "label": "colorLabel",
    "camera": "cameraModel", "lens": "lensModel", "iso": "iso", "aperture": "aperture", "focal_length": "focalLength", "captured": "dateCapturedEpoch",
}


@dataclass(frozen=True)
class Condition:
    """``field op value``; ``upper`` is for ``between``, whose ends are included; without it the condition is null."""

    field: str
    op: str
    value: object = None
    upper: object = None

    def column(self, fields: dict[str, str] | None = None, ignore_case: bool = True) -> Column:
        if self.op not in OPS:
            raise ValueError(f"unknown comparison {self.op}")
        c = F.col((fields or {}).get(self.field, self.field))
        if self.op == "between":
            return (c >= F.lit(self.value)) & (c <= F.lit(self.upper))
        if self.op in ("contains", "not_contains", "starts", "ends"):
            if not isinstance(self.value, str):
                return c.isNotNull() if self.op != "not_contains" else F.lit(False)
            own, value = (F.lower(c), self.value.lower()) if ignore_case else (c, self.value)
            found = {"starts": own.startswith, "ends": own.endswith}.get(self.op, own.contains)(F.lit(value))
            return ~found if self.op == "not_contains" else found
        if self.op == "regex":
            return c.rlike(str(self.value))
        value = F.lit(self.value)
        return {"eq": c == value, "ne": c != value, "gt": c > value, "lt": c < value, "ge": c >= value, "le": c <= value}[self.op]


#: What a caller's own predicate may call and which key words it may use; all else is an error.
EXPRESSION_WORDS = frozenset({
    "and", "or", "not", "in", "between", "like", "rlike", "is", "null", "true", "false", "case", "when", "then", "else", "end", "lower", "upper", "trim", "length", "coalesce", "abs", "round",
    "contains", "startswith", "endswith", "date", "timestamp", "year", "month", "day",
})


def checked_expression(text: str) -> str:
    """A SQL predicate of column names, literals, comparisons, arithmetic and :data:`EXPRESSION_WORDS`; anything else (subqueries, other functions, statements) is refused."""
    bare = re.sub(r"'(?:[^'\\]|\\.|'')*'", "''", text)
    if not re.fullmatch(r"[\w\s.,()+\-*/%<>=!'`]*", bare) or "--" in bare or "/*" in bare:
        raise ValueError(f"not allowed in a predicate: {text}")
    for word in re.findall(r"([A-Za-z_]\w*)\s*\(", bare):
        if word.lower() not in EXPRESSION_WORDS:
            raise ValueError(f"not allowed in a predicate: {word}")
    if re.search(r"\b(select|from|union|with|join|lateral|insert|drop|create)\b", bare, re.I):
        raise ValueError(f"not allowed in a predicate: {text}")
    return text


@dataclass(frozen=True)
class Node:
    """A tree of conditions: ``and``, ``or``, ``not`` (of all its children: none may hold), or ``expr``, a SQL predicate of the caller's own."""

    kind: str
    children: tuple[Condition | Node, ...] = ()
    expr: str = ""

    def column(self, fields: dict[str, str] | None = None, ignore_case: bool = True) -> Column:
        if self.kind == "expr":
            return F.expr(checked_expression(self.expr))
        parts = [child.column(fields, ignore_case) for child in self.children]
        if not parts:
            return F.lit(True)
        if self.kind == "and":
            return reduce(lambda a, b: a & b, parts)
        either = reduce(lambda a, b: a | b, parts)
        if self.kind == "or":
            return either
        if self.kind == "not":
            return ~either
        raise ValueError(f"unknown kind of node {self.kind}")


def scoped(df: DataFrame, tree: Condition | Node, parent_col: str, parent_id: object, fields: dict[str, str] | None = None) -> DataFrame:
    """The rows below one parent for which the tree holds."""
    return df.where(F.col(parent_col) == F.lit(parent_id)).where(tree.column(fields))


def to_json(tree: Condition | Node) -> str:
    return json.dumps(_plain(tree))


def _plain(tree: Condition | Node) -> dict:
    if isinstance(tree, Condition):
        return asdict(tree)
    return {"kind": tree.kind, "expr": tree.expr, "children": [_plain(c) for c in tree.children]}


def from_json(text: str) -> Condition | Node:
    return _tree(json.loads(text))


def _tree(raw: dict) -> Condition | Node:
    if "kind" in raw:
        return Node(raw["kind"], tuple(_tree(c) for c in raw.get("children", ())), raw.get("expr", ""))
    return Condition(raw["field"], raw["op"], raw.get("value"), raw.get("upper"))


def interpreted(tree: Condition | Node, known: set[str], is_folder: Column) -> Column:
    """The tree where only some fields are at hand: conditions on others hold, as do all for folders; text is compared by case."""

    def column(node: Condition | Node) -> Column:
        if isinstance(node, Condition):
            return node.column(ignore_case=False) if node.field in known else F.lit(True)
        if node.kind == "expr":
            return F.lit(True)
        parts = [column(c) for c in node.children]
        if not parts:
            return F.lit(True)
        joined = reduce((lambda a, b: a & b) if node.kind == "and" else (lambda a, b: a | b), parts)
        return ~joined if node.kind == "not" else joined

    return is_folder | column(tree)


def exif_filter(camera: str = "", lens: str = "", aperture: float = 0, focal_length: float = 0, iso: int = 0) -> Node:
    """Camera and lens by equality; aperture, focal length and iso as lower bounds where above 0."""
    parts: list[Condition | Node] = [Condition(f, "eq", v) for f, v in (("camera", camera), ("lens", lens)) if v]
    parts += [Condition(f, "ge", v) for f, v in (("aperture", aperture), ("focal_length", focal_length), ("iso", iso)) if v > 0]
    return Node("and", tuple(parts))


def date_filter(column: str, begin: object = None, end: object = None) -> Node:
    """From ``begin`` to ``end``, both included; one that is not given (or 0) is open."""
    parts = [Condition(column, "ge", begin)] if begin else []
    parts += [Condition(column, "le", end)] if end else []
    return Node("and", tuple(parts))


@dataclass
class CatalogFilter:
    """What an album page asks for; everything is optional, and all of it is applied before the page is cut."""

    folder: str | None = None
    text: str | None = None
    rating_min: int = 0
    rating_max: int = 5
    flags: list[str] = field(default_factory=list)
    labels: list[str] = field(default_factory=list)
    extensions: list[str] = field(default_factory=list)
    any_tag: list[str] = field(default_factory=list)
    date_from: int | None = None
    date_to: int | None = None
    camera: str | None = None
    lens: str | None = None
    iso: tuple[int, int] | None = None
    aperture: tuple[float, float] | None = None
    focal_length: tuple[float, float] | None = None
    shutter: tuple[str, ...] | None = None
    include_hidden: bool = False

    def is_empty(self) -> bool:
        """Whether nothing but hidden rows is asked for."""
        return asdict(self) | {"include_hidden": False} == asdict(CatalogFilter())

    def column(self) -> Column:
        """The predicate over the images table; what is not asked for is not in it."""
        from heliograph.functions.text import tags_split

        parts: list[Column] = []
        if self.folder is not None:
            parts.append(parent(F.col("sleevePath")) == normalised(F.lit(self.folder)))
        if not self.include_hidden:
            parts.append(~F.coalesce(F.col("isHidden"), F.lit(False)))
        if self.rating_min > 0:
            parts.append(F.col("rating") >= self.rating_min)
        if self.rating_max < 5:
            parts.append(F.col("rating") <= self.rating_max)
        if self.text and self.text.strip():
            wanted = F.lit(self.text.strip().lower())
            parts.append(F.lower("displayName").contains(wanted) | F.coalesce(F.lower("aiCaption").contains(wanted), F.lit(False)))
        for column, values in (("flag", self.flags), ("colorLabel", self.labels), ("shutterSpeed", self.shutter)):
            if values:
                parts.append(F.col(column).isin(*values))
        if self.extensions:
            parts.append(F.lower("fileExtension").isin(*(e.lower() for e in self.extensions)))
        if self.any_tag:
            parts.append(F.arrays_overlap(tags_split(F.col("aiTags")), F.array(*(F.lit(t) for t in self.any_tag))))
        for column, low, high in (
            ("dateCapturedEpoch", self.date_from, self.date_to), ("iso", *(self.iso or (None, None))), ("aperture", *(self.aperture or (None, None))),
            ("focalLength", *(self.focal_length or (None, None))),
        ):
            if low is not None:
                parts.append(F.col(column) >= low)
            if high is not None:
                parts.append(F.col(column) <= high)
        for column, value in (("cameraModel", self.camera), ("lensModel", self.lens)):
            if value:
                parts.append(F.lower(column) == value.lower())
        return reduce(lambda a, b: a & b, parts, F.lit(True))


def dispatch(df: DataFrame, request: str, name_col: str, folder_col: str) -> DataFrame:
    """A JSON request: ``query``, a text sought in names, or ``folder`` with an optional ``filter`` tree; anything else gives no rows."""
    try:
        raw = json.loads(request)
    except ValueError:
        return df.limit(0)
    if isinstance(raw, dict) and isinstance(raw.get("query"), str):
        return df.where(F.col(name_col).contains(raw["query"]))
    if isinstance(raw, dict) and "folder" in raw:
        rows = df.where(F.col(folder_col) == F.lit(raw["folder"]))
        return rows.where(_tree(raw["filter"]).column()) if raw.get("filter") else rows
    return df.limit(0)
