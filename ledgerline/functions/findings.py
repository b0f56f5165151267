"""Findings in the lines of a pathology page: specimens, assays, labelled fields, stained markers with scores or results.

What a line means depends on the lines around it: a section heading decides whether
results below it count, anchors (specimen, assay) may come after what is bound to them,
and two anchors leave a result unbound.  So a page is read as a whole, in line order.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

# Labels, headings and words of such reports.
IDENTITY = ("肿瘤样本编号", "标本编号", "标本号", "样本编号", "蜡块编号", "组织块号")
MATERIAL = ("标本类型", "样本类型", "送检材料", "标本名称")
ASSAY = ("检测项目", "检测名称")
TEXTS = {"标本类型": "specimen.description", "样本类型": "specimen.description", "送检材料": "specimen.description", "标本名称": "specimen.description", "标本描述": "specimen.description",
         "取材部位": "specimen.site", "送检部位": "specimen.site", "取材方式": "specimen.procedure", "抗体克隆号": "assay.antibody", "抗体克隆": "assay.antibody", "克隆号": "assay.antibody"}
ASSERTED = {"组织学诊断": "specimen.histology", "病理诊断": "specimen.histology", "分化程度": "specimen.differentiation", "切缘": "specimen.margin", "脉管浸润": "specimen.invasion", "浸润": "specimen.invasion", "病理分期": "pathology.reported_stage"}
DATES = {"采样日期": "collection_date", "采集日期": "collection_date", "取材日期": "collection_date", "收样日期": "received_date", "接收日期": "received_date", "接收时间": "received_date",
         "样本接收日期": "received_date", "样本接收时间": "received_date", "报告日期": "report_date", "报告时间": "report_date"}
SIZES = {"标本大小": "SPECIMEN", "肿瘤大小": "TUMOR"}
OTHER = ("检测方法", "抗体名称", "检测结果", "染色结果", "免疫组化结果", "免疫组织化学结果", "质控", "质量控制", "阳性对照", "阴性对照", "说明", "备注", "临床诊断", "送检诊断")
#: Below these neither results nor anchors count; below those that the sender supplied no results; below the last all do again.
SECTIONS = {
    "excluded": r"(?:样本质控|质控|质量控制)(?:结果)?(?:[:：]|$)|(?:阳性对照|阴性对照|检测图谱|染色图像|染色图谱|检测说明|说明|备注)(?:[:：]|$)",
    "supplied": r"(?:(?:受检者|患者|病人)(?:基本|临床)?信息|基本信息|送检(?:信息|资料)|临床(?:信息|资料))[:：]?$",
    "current": r"(?:(?:病理|组织学)?诊断(?:结果|意见)|(?:检测|染色|免疫组化|免疫组织化学)结果)(?:[:：]|$)",
}
NO_RESULT = r"^(?:质控|质量控制|阳性对照|阴性对照|说明|备注|解释|临床诊断|送检诊断)|(?:既往|历史|上次).{0,12}(?:结果|TPS|CPS)"
NOT_NOW = r"既往|历史|上次|对照|质控|参考|示例|计划|拟检测"
NOT_MEASURED = r"待测|未检测|未做检测"
MARKERS = ("PD-L1", "HER-2", "Ki-67", "MLH1", "MSH2", "MSH6", "PMS2", "ALK", "ER", "PR", "TTF-1", "NapsinA", "P40", "P63")
NOTHING = r"(?:[/／-]|未提供|未注明|不详|未知|未检测|无)$"
ASSERTIONS = {
    "NOT_TESTED": r"未检测(?!到)|未做|未行检测",
    "UNCERTAIN": r"不确定|不能确定|可疑|疑似|倾向|不能排除|不除外",
    "NOT_DETECTED": r"未检出|未检测到",
    "NEGATIVE": r"阴性|未见|未发现|无浸润",
    "POSITIVE": r"阳性",
    "DETECTED": r"检出|检测到",
}
TITLE = r"[A-Za-z0-9-]{2,30}(?:免疫组化|免疫组织化学|IHC)检测|(?:免疫组化|免疫组织化学)\([A-Za-z0-9-]{2,30}\)检测"
COMPARE = {"<=": "LE", "≤": "LE", ">=": "GE", "≥": "GE", "<": "LT", ">": "GT"}
# End of the fixed values.

_LABELS = re.compile("(" + "|".join(sorted({*IDENTITY, *MATERIAL, *ASSAY, *TEXTS, *ASSERTED, *DATES, *SIZES, *OTHER}, key=len, reverse=True)) + "):")
_SECTIONS = {name: re.compile(pattern) for name, pattern in SECTIONS.items()}
_MARKER = re.compile("|".join(m.replace("-", "-?") for m in MARKERS), re.I)
_NUMBER = r"\d+(?:\.\d+)?"
_SCORE = re.compile(rf"(?<![A-Za-z])(TPS|CPS|IC)[:=]?(约|~|≈)?(<=|>=|[≤≥<>])?({_NUMBER})(?:[-–—~至]({_NUMBER}))?(%|分)?", re.I)
_SIZE = re.compile(rf"{_NUMBER}(?:cm|mm)?(?:[x×*]{_NUMBER}(?:cm|mm)?){{0,2}}(?<=m)", re.I)
_DAY = re.compile(r"(\d{4})[-/.年](\d{1,2})(?:[-/.月](\d{1,2}))?")


@dataclass
class View:
    """A line for matching: NFKC without white space, dashes alike; ``at`` leads back to the line's own characters."""

    line: str
    text: str = ""
    at: list[int] = field(default_factory=list)

    def __post_init__(self):
        for k, c in enumerate(self.line):
            for x in unicodedata.normalize("NFKC", c):
                if not x.isspace():
                    self.text += "-" if x in "‐‑–" else x
                    self.at.append(k)

    def span(self, start: int, end: int) -> tuple[int, int]:
        return (self.at[start], self.at[end - 1] + 1) if end > start else (0, 0)

    def raw(self, start: int, end: int) -> str:
        a, b = self.span(start, end)
        return self.line[a:b]


@dataclass
class Finding:
    key: str
    entity: str
    value: dict[str, str]
    line: int
    start: int
    end: int
    raw: str
    role: str
    specimen: int | None = None
    assay: int | None = None
    marker: int | None = None
    limits: list[str] = field(default_factory=list)


@dataclass
class Cell:
    """A label and what stands behind it, up to the next label or the end of its line."""

    line: int
    label: str
    view: View
    label_at: int
    start: int
    end: int

    @property
    def raw(self) -> str:
        return self.view.raw(self.start, self.end)


def asserted(text: str) -> str:
    return next((name for name, pattern in ASSERTIONS.items() if re.search(pattern, text)), "SOURCE_TEXT_ONLY")


def score(m: re.Match, after: str) -> dict[str, str] | None:
    """The value of a printed score; None where signs run on, two numbers have a comparison or a proportion passes 100."""
    kind, about, compare, first, second, unit = m.groups()
    runs_on = re.match(r"[A-Za-z0-9.+/%-]", after) and not re.match(r"(?:TPS|CPS|IC)[:=]", after, re.I)
    if runs_on or second and compare or kind.upper() != "CPS" and float(second or first) > 100:
        return None
    values = f"{first}-{second}" if second else first
    return {"score": kind.upper(), "values": values, "comparator": "RANGE" if second else COMPARE.get(compare, "EQ"), "unit": unit or "", "approximate": str(bool(about)).lower()}


class Page:
    """The automaton over one page's lines."""

    def __init__(self, lines: list[str | None]):
        self.views = [View(x or "") for x in lines]
        self.found: list[Finding] = []
        self.sections()
        self.cells = [c for n, v in enumerate(self.views) if self.section[n] != "excluded" for c in self.labelled(n, v)]
        self.anchors()
        for cell in self.cells:
            self.labelled_field(cell)
        self.stained()

    def sections(self) -> None:
        now, self.section = "current", []
        for v in self.views:
            now = next((name for name, p in _SECTIONS.items() if p.match(v.text)), now)
            self.section.append(now)

    def labelled(self, n: int, v: View) -> list[Cell]:
        labels = list(_LABELS.finditer(v.text))
        ends = [*(m.start() for m in labels[1:]), len(v.text)][: len(labels)]
        cells = [Cell(n, m[1], v, m.start(), m.end(), end) for m, end in zip(labels, ends, strict=True)]
        return [c for c in cells if c.end > c.start and not re.fullmatch(NOTHING, v.text[c.start : c.end])]

    def add(self, key: str, entity: str, value: dict[str, str], n: int, start: int, end: int, role: str, **links) -> int:
        view = self.views[n]
        self.found.append(Finding(key, entity, value, n, *view.span(start, end), view.raw(start, end), role, **links))
        return len(self.found) - 1

    def anchors(self) -> None:
        self.specimens: list[int] = []
        for c in self.cells:
            if c.label in IDENTITY and all(self.found[i].raw != c.raw for i in self.specimens):
                self.specimens.append(self.add("specimen.identity", f"specimen:{len(self.specimens) + 1}", {"label": c.raw}, c.line, c.start, c.end, "METADATA"))
        material = [c for c in self.cells if c.label in MATERIAL]
        if not self.specimens and len(material) == 1:
            c = material[0]
            self.specimens.append(self.add("specimen.identity", "specimen:1", {"label": c.raw}, c.line, c.start, c.end, "METADATA", limits=["material_only"]))
        self.assays: list[int] = []
        spans = [(c.line, c.start, c.end) for c in self.cells if c.label in ASSAY]
        if not spans:
            spans = [(n, 0, len(v.text)) for n, v in enumerate(self.views) if self.section[n] != "excluded" and re.fullmatch(TITLE, v.text, re.I)]
        for n, start, end in spans:
            raw = self.views[n].raw(start, end)
            self.assays.append(self.add("assay.identity", f"assay:{len(self.assays) + 1}", {"label": raw}, n, start, end, "METADATA", specimen=self.specimen(n)))

    def specimen(self, n: int) -> int | None:
        """The one that the line names, or the only one of the page."""
        named = [i for i in self.specimens if re.search(rf"(?<![\w-]){re.escape(self.found[i].raw)}(?![\w-])", self.views[n].line)]
        return named[0] if len(named) == 1 else self.specimens[0] if len(self.specimens) == 1 else None

    def assay(self, n: int) -> int | None:
        fits = [i for i in self.assays if self.found[i].specimen == self.specimen(n)]
        named = [i for i in fits if self.found[i].raw in self.views[n].line]
        return named[0] if len(named) == 1 else fits[0] if len(fits) == 1 else None

    def labelled_field(self, c: Cell) -> None:
        text, supplied = c.view.text[c.start : c.end], self.section[c.line] == "supplied"
        if re.search(NO_RESULT, c.view.text) or supplied and c.label in ASSERTED:
            return
        specimen, assay = self.specimen(c.line), self.assay(c.line)
        if c.label in SIZES:
            for m in _SIZE.finditer(text):
                if specimen is not None:
                    self.add("specimen.dimensions", self.found[specimen].entity, {"literal": m[0], "of": SIZES[c.label]}, c.line, c.start + m.start(), c.start + m.end(), "CURRENT_RESULT", specimen=specimen)
            return
        key, value = TEXTS.get(c.label) or ASSERTED.get(c.label), {"text": c.raw}
        if c.label in ASSERTED:
            value["assertion"] = asserted(text)
        elif c.label in DATES:
            days = _DAY.findall(text)
            if len(days) != 1:
                return
            year, month, day = days[0]
            key, value = f"assay.{DATES[c.label]}", {"value": "-".join([year, month.zfill(2), *([day.zfill(2)] if day else [])]), "precision": "DAY" if day else "MONTH"}
        elif c.label == "检测方法":
            code = "IHC" if re.fullmatch("IHC|免疫组化|免疫组织化学", text, re.I) else "ISH" if re.fullmatch("ISH|原位杂交", text, re.I) else "OTHER"
            key, value = "assay.method", {"code": code, "text": c.raw}
        if key is None:
            return
        owner = {"assay": assay, "specimen": specimen}.get(key.split(".")[0])
        if owner is None and not key.startswith("pathology."):
            return  # nothing that it could be a property of
        links = {} if owner is None else {"specimen": specimen} | ({"assay": assay} if key.startswith("assay.") else {})
        role = "CURRENT_RESULT" if c.label in ASSERTED else "METADATA"
        self.add(key, "report" if owner is None else self.found[owner].entity, value, c.line, c.start, c.end, role, **links)

    def stained(self) -> None:
        count = 0
        skip = re.compile("|".join(f"{x}:" for x in (*ASSAY, "抗体克隆号", "临床诊断")))
        for n, v in enumerate(self.views):
            if self.section[n] != "current" or re.search(NO_RESULT, v.text) or skip.search(v.text):
                continue
            matches = [m for m in _MARKER.finditer(v.text) if self.apart(v, m)]
            now = not re.search(NOT_NOW, v.text)
            for m, after in zip(matches, [*matches[1:], None], strict=False):
                end = after.start() if after else len(v.text)
                tail = v.text[m.end() : end]
                if not now or v.text[: m.start()].endswith("非"):
                    continue
                scores = [] if re.search(NOT_MEASURED, tail) else list(_SCORE.finditer(tail))
                said = asserted(tail.lstrip(":"))
                if not scores and said == "SOURCE_TEXT_ONLY":
                    continue
                count += 1
                links = {"specimen": self.specimen(n), "assay": self.assay(n)}
                limits = [f"unlinked_{k}" for k, x in links.items() if x is None]
                code = m[0].upper().replace("-", "")
                marker = self.add("ihc.marker", f"ihc:{count}", {"code": {"PDL1": "PD_L1"}.get(code, code)}, n, *m.span(), "CURRENT_RESULT", limits=limits, **links)
                for s in scores:
                    if (value := score(s, tail[s.end() :])) is not None:
                        self.add("ihc.score", f"ihc:{count}", value, n, m.end() + s.start(), m.end() + s.end(), "CURRENT_RESULT", limits=limits, marker=marker, **links)
                if not scores:
                    start = m.end() + (tail[:1] == ":")
                    self.add("ihc.result", f"ihc:{count}", {"text": v.raw(start, end), "assertion": said}, n, start, end, "CURRENT_RESULT", limits=limits, marker=marker, **links)

    @staticmethod
    def apart(v: View, m: re.Match) -> bool:
        """Whether no letter, digit or dash of the line itself touches the marker, but for a score's name behind it."""
        a, b = v.span(*m.span())
        if re.match(r"[A-Za-z0-9-]", v.line[a - 1 : a] if a else ""):
            return False
        return not re.match(r"[A-Za-z0-9-]", v.line[b : b + 1]) or bool(re.match(r"(?:TPS|CPS|IC)[:=]", v.text[m.end() :], re.I))
