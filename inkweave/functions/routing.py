"""Question routing: whether a question compares papers, and its scale (cross_paper, verification, detail, summary)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and patterns of the routing rules, in English and Chinese.
CROSS_WORDS = ("compare to", "compare with", "compared to", "compared with", "versus", " vs ", " vs.", "另一篇", "其他论文", "两篇论文", "两篇", "多篇文章", "跨论文", "另一篇文章", "上一篇", "上一篇论文")
CROSS_PATTERNS = ("对比.*(另一|其他|两篇)", "(矛盾|差异).*(两篇|论文)", "与.*上一篇", "相比.*(上一|另一|其他)")
PAPER_ID = r"\b([a-z][a-z0-9]*-\d{3,})\b"
VERIFICATION_WORDS = ("哪些材料", "哪些节点", "如何论证", "如何验证", "什么证据", "哪些证据", "发挥了什么作用", "经何种理论视角被论证", "通过哪些材料", "证据链", "实验指标", "数据集指标")
MACRO_WORDS = ("整篇", "演进脉络", "总体而言", "总体上看", "全文脉络", "宏观脉络", "全文视角")
MACRO_PATTERNS = ("总体.*(观点|结论|脉络|框架|贡献)", "整篇.*(论文|文章|研究)", r"对比\s*(两篇|两构型|两种方法|两个论文)", "(两篇|两构型).{0,16}对比")
#: Whole words, and texts that count inside a word, too.
DETAIL_WORDS = ("dataset", "accuracy", "f1-score", "table", "figure", "parameter", "baseline", "metric", "hyperparameter", "p-value", "p value", "mnist", "imagenet", "resnet", "experiment", "page", "method", "detail")
DETAIL_PARTS = ("f1", "section", "数值", "数据集", "准确率", "参数", "实验结果", "表格", "图表", "分论点", "如何支撑", "如何设计", "模块", "方法", "论证链", "细节", "具体", "与基线", "区别", "采用了", "分析", "提到了哪些", "第几页", "多少")
RELATION_PATTERNS = (
    "(?i:(实体|节点|指标|数据集|分论点|核心论点|理论视角|论证|方法|模块|基线|claim|metric|dataset|method|node|lens_of).{0,24}(关系|逻辑关系))", "(?i:(关系|逻辑关系).{0,24}(实体|节点|指标|数据集|分论点|核心论点|理论视角|节点))",
    "与.{1,36}(关系|逻辑关系)", "之间.{0,12}(是什么|有).{0,8}(逻辑)?关系", "存在.{0,8}什么关系", "论证关系", r"(是什么关系|有何关联|什么关系)\s*[？?]", r"(?i:LENS_OF\s*关系)",
)
RELATION_EXCLUSIONS = ("(这两篇|两篇论文|两构型|两种构型|方法论|整体结论|论文结论|全文).{0,30}(关系|逻辑关系)", "(关系|逻辑关系).{0,16}(这两篇|两篇论文|两构型|方法论)")
NUMBER = r"\b\d+(?:\.\d+)?%?\b"

#: Java reads \b, \d and \s as Unicode classes and ends lines at \n only.
_FLAGS = "(?dU)"


def _words(q: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(q, F.lit(w)) for w in words])


def _search(q: Column, *patterns: str) -> Column:
    return q.rlike(_FLAGS + "|".join(f"(?:{p})" for p in patterns))


def cross_paper(q: Column, paper: Column | None = None) -> Column:
    """Whether a question is about other papers; with `paper` (null or blank: unknown) also where it names another id."""
    out = _words(F.concat(F.lit(" "), F.lower(F.trim(q)), F.lit(" ")), CROSS_WORDS) | _search(q, *CROSS_PATTERNS)
    if paper is None:
        return out
    named = F.regexp_extract_all(F.lower(q), F.lit(_FLAGS + PAPER_ID), F.lit(1))
    mine = F.lower(F.trim(paper))
    return out | F.coalesce((mine != "") & (F.size(F.filter(named, lambda n: n != mine)) > 0), F.lit(False))


def question_scale(q: Column, paradigm: Column | None = None, paper: Column | None = None) -> Column:
    """cross_paper, else verification, else summary for macro wording, else detail, else summary; null questions are empty."""
    q = F.coalesce(q, F.lit(""))
    side = F.lit("") if paradigm is None else F.coalesce(paradigm, F.lit(""))
    stem, hss = side == "STEM", side == "HSS"
    verify = _words(q, VERIFICATION_WORDS) | (stem & _words(q, ("实验", "指标", "验证")) & _words(q, ("哪些", "如何", "是否", "证据"))) | (hss & _words(q, ("材料", "史料")) & _words(q, ("哪些", "如何")))
    macro = _words(q, MACRO_WORDS) | _search(q, *MACRO_PATTERNS)
    low = F.lower(q)
    relation = _search(q, *RELATION_PATTERNS) & ~_search(q, *RELATION_EXCLUSIONS)
    detail = _search(low, rf"\b(?:{'|'.join(DETAIL_WORDS)})\b") | _words(low, DETAIL_PARTS) | relation | _search(q, NUMBER)
    detail = detail | (stem & _words(q, ("方法", "模块", "架构"))) | (hss & _words(q, ("分论点", "支撑", "理论视角")) & ~_words(q, ("哪些材料", "如何论证")))
    return F.when(cross_paper(q, paper), "cross_paper").when(verify, "verification").when(macro, "summary").when(detail, "detail").otherwise("summary")
