"""Variants in the grid of a molecular report: records put together from cells under headers that change down the page.

A header row names columns until the next one; a cell belongs to the nearest header.  One
column may hold several components of a variant, a gene stands for the rows below it that
leave its cell empty, and what two places say differently isn't settled.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

# Headers, headings and words of such reports.
HEADERS = {
    "基因": "gene", "基因名称": "gene", "检测基因": "gene", "变异": "variant", "突变": "variant", "变异位点": "variant", "检测结果": "variant", "核苷酸变化": "coding", "碱基改变": "coding", "氨基酸变化": "protein", "氨基酸改变": "protein",
    "转录本": "transcript", "外显子": "exon", "丰度": "fraction", "突变丰度": "fraction", "突变频率": "fraction", "变异频率": "fraction", "拷贝数": "copies", "结果": "assertion", "检出情况": "assertion",
}
ROLES = {"历史": "HISTORICAL", "既往": "HISTORICAL", "上次": "HISTORICAL", "送检诊断": "SUBMITTED", "临床诊断": "SUBMITTED", "质控": "QC", "质量控制": "QC", "阳性对照": "CONTROL", "阴性对照": "CONTROL", "对照": "CONTROL", "说明": "EXPLANATION", "备注": "EXPLANATION"}
CURRENT = {"体细胞": "SOMATIC", "胚系": "GERMLINE", "检测结果": "UNKNOWN", "基因检测结果": "UNKNOWN"}
ASSERTIONS = {"阳性": "POSITIVE", "检出": "DETECTED", "阴性": "NEGATIVE", "未检出": "NOT_DETECTED", "不确定": "UNCERTAIN", "未检测": "NOT_TESTED"}
# End of the fixed values.

_COMPONENTS = {
    "transcript": re.compile(r"\b[NX]M_\d+(?:\.\d+)?"),
    "coding": re.compile(r"c\.[0-9*_+\-A-Za-z>]+"),
    "protein": re.compile(r"p\.\(?[A-Za-z0-9*_=]+\)?"),
    "exon": re.compile(r"(?:外显子|exon|ex)\s*\d+|\d+\s*号?外显子", re.I),
    "fusion": re.compile(r"\b[A-Z][A-Z0-9]{1,9}(?:-|::)[A-Z][A-Z0-9]{1,9}\b(?=\s*(?:融合|fusion))", re.I),
}
_GENE = re.compile(r"(?<![A-Za-z0-9_.])[A-Z][A-Z0-9]{1,9}(?![A-Za-z0-9_.])")
_PART = re.compile(r"(<=|>=|[<>≤≥])?\s*(\d+(?:\.\d+)?)\s*(%)?")
_COMPARE = {"<=": "LE", "≤": "LE", ">=": "GE", "≥": "GE", "<": "LT", ">": "GT", None: "EQ"}


@dataclass(frozen=True)
class Component:
    """What a record took from a cell: name, value, the cell's place and the characters there."""

    name: str
    value: str
    row: int
    x: float
    start: int
    end: int


@dataclass
class Record:
    row: int
    role: str
    scope: str
    status: str = "COMPLETE"
    assertion: str | None = None
    parts: list[Component] = field(default_factory=list)

    def values(self, name: str) -> list[str]:
        return sorted({p.value for p in self.parts if p.name == name})


def _plain(text: str) -> str:
    """NFKC sign for sign, so that places stay; a sign that would become several is left."""
    return "".join(n if len(n := unicodedata.normalize("NFKC", c)) == 1 else c for c in text)


def components(column: str, text: str, row: int, x: float) -> list[Component]:
    """The components of a cell of a column."""
    plain, out = _plain(text), []

    def take(name: str, m: re.Match, value: str | None = None) -> None:
        out.append(Component(name, value or re.sub(r"\s", "", m[0]), row, x, m.start(), m.end()))

    if column in ("fraction", "copies"):
        m = _PART.fullmatch(plain.strip())
        if m and not (column == "fraction" and m[3] and float(m[2]) > 100):
            start = len(plain) - len(plain.lstrip())
            out.append(Component(column, f"{_COMPARE[m[1]]} {m[2]}{m[3] or ''}", row, x, start, start + len(m[0])))
        return out
    if column == "exon" and (m := re.fullmatch(r"\s*(\d+)\s*", plain)):
        return [Component("exon", m[1], row, x, m.start(1), m.end(1))]
    taken = plain
    for name, pattern in _COMPONENTS.items():
        for m in pattern.finditer(taken):
            if name == "fusion":
                take("fusion", m, m[0].replace("::", "-"))
            else:
                take(name, m, re.sub(r"\D", "", m[0]) if name == "exon" else None)
            taken = taken[: m.start()] + "\0" * (m.end() - m.start()) + taken[m.end() :]
    if column in ("gene", "variant"):
        for m in _GENE.finditer(taken):
            take("gene", m)
    return out


class Grid:
    """The automaton over the rows of a page, each a list of (x, text)."""

    def __init__(self, rows: list[list[tuple[float, str]]]):
        self.records: list[Record] = []
        self.head: list[tuple[float, str]] = []
        self.role, self.scope, self.gene = "CURRENT", "UNKNOWN", None
        for n, cells in enumerate(rows):
            self.step(n, [(x, t) for x, t in sorted(cells) if t.strip()])

    def step(self, n: int, cells: list[tuple[float, str]]) -> None:
        names = [(x, HEADERS.get(re.sub(r"\s", "", _plain(t)))) for x, t in cells]
        named = [name for _, name in names if name]
        if len(named) > 1:
            # two columns of one name can't be told apart
            self.head, self.gene = ([(x, name) for x, name in names if name] if len(named) == len(set(named)) else []), None
        elif len(cells) == 1 and self.heading(_plain(cells[0][1]).strip()):
            self.head, self.gene = [], None
        elif self.head and cells:
            self.record(n, cells)

    def heading(self, text: str) -> bool:
        role = next((r for word, r in ROLES.items() if text.startswith(word)), None)
        scope = next((s for word, s in CURRENT.items() if text.startswith(word)), None)
        if role:
            self.role = role
        elif scope:
            self.role, self.scope = "CURRENT", scope
        return bool(role or scope)

    def record(self, n: int, cells: list[tuple[float, str]]) -> None:
        made, columns = Record(n, self.role, self.scope), {}
        for x, text in cells:
            near = sorted((abs(x - at), name) for at, name in self.head)
            # a cell right between two headers is in neither
            if len(near) < 2 or near[0][0] < near[1][0]:
                columns.setdefault(near[0][1], []).append((x, text))
        for column, own in columns.items():
            for x, text in own:
                if column == "assertion":
                    made.assertion = ASSERTIONS.get(_plain(text).strip(), made.assertion)
                else:
                    made.parts += components(column, text, n, x)
        if "gene" in columns:
            genes = [p for p in made.parts if p.name == "gene"]
            self.gene = genes[0] if len({p.value for p in genes}) == 1 else None
        elif self.gene and not made.values("gene") and not made.values("fusion"):
            made.parts.append(self.gene)
        if not made.parts:
            return
        changes = ("coding", "protein", "fusion", "copies")
        if any(len(made.values(name)) > 1 for name in ("gene", "coding", "protein", "transcript", "exon", "fraction", "copies", "fusion")):
            made.status = "UNRESOLVED"
        elif not any(made.values(name) for name in changes) or not (made.values("gene") or made.values("fusion")):
            made.status = "INCOMPLETE"
        self.records.append(made)
