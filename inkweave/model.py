"""Fixed values of the data model: types, statuses, thresholds. They must equal the reference's for equal results."""

STEM_NODE_TYPES = ("ResearchQuestion", "Method", "Dataset", "Metric", "Baseline", "Experiment", "Claim", "Evidence", "Finding")
HSS_NODE_TYPES = ("Thesis", "SubArgument", "AnalyticalLens", "IntellectualContext", "ObjectOrData", "Claim", "Evidence")
STEM_EDGE_TYPES = ("ADDRESSES", "USES_METHOD", "EVALUATED_ON", "MEASURED_BY", "COMPARES_TO", "SUPPORTS", "PRODUCES", "RELATES_TO")
HSS_EDGE_TYPES = ("CHALLENGES", "SUB_ARGUMENT_OF", "EXAMINES_THROUGH", "SUPPORTS", "CONTEXTUALIZES", "RELATES_TO", "LENS_OF", "INFORMS", "REF")
FORBIDDEN_EDGE_TYPES = ("SUPPORTED_BY",)
CORE_EDGE_TYPES = ("SUPPORTS", "CONTRADICTS", "EXPLAINS")
DYNAMIC_EDGE_TYPE = "^[A-Z][A-Z0-9_]*$"

#: Legal (from, to) pairs of paper statuses.
TRANSITIONS = (
    ("pending", "processing"), ("pending", "indexing"), ("pending", "ready"), ("pending", "ready_with_warnings"), ("pending", "failed"),
    ("processing", "processing"), ("processing", "indexing"), ("processing", "ready"), ("processing", "ready_with_warnings"), ("processing", "failed"),
    ("indexing", "indexing"), ("indexing", "ready"), ("indexing", "ready_with_warnings"), ("indexing", "failed"),
    ("ready", "ready"), ("ready", "ready_with_warnings"), ("ready", "failed"), ("ready", "processing"),
    ("ready_with_warnings", "ready_with_warnings"), ("ready_with_warnings", "ready"), ("ready_with_warnings", "failed"), ("ready_with_warnings", "processing"),
    ("failed", "failed"), ("failed", "pending"), ("failed", "processing"),
)
STAGE_PERCENT = {"ingesting": 20, "head_refining": 35, "classifying": 50, "extracting": 80, "storing": 95, "indexing": 98, "ready": 100, "failed": 0}

MIN_SUPPORTS_COVERAGE, MAX_ISOLATED_RATIO, MAX_GENERIC_RATIO = 0.5, 0.4, 1.0
MAX_SKELETON_NODES = 300
LABEL_MAX, SPAN_MAX = 120, 500

#: Section titles and their canonical names.
SECTION_ALIASES = {
    "abstract": "abstract", "summary": "abstract", "introduction": "introduction", "related work": "related_work", "background": "background", "preliminaries": "preliminaries",
    "method": "methods", "methods": "methods", "methodology": "methods", "model": "methods", "architecture": "methods",
    "experiment": "experiments", "experiments": "experiments", "experimental setup": "experiments",
    "evaluation": "results", "results": "results", "findings": "results", "discussion": "discussion",
    "conclusion": "conclusion", "conclusions": "conclusion", "appendix": "appendix", "references": "references", "bibliography": "references", "works cited": "references",
}

STEM_KEYWORDS = (
    "ablation", "accuracy", "algorithm", "baseline", "benchmark", "dataset", "datasets", "experiment", "experiments", "f1", "metric", "model", "performance", "quantitative", "training", "agent", "framework",
    "算法", "基线", "大模型", "实验", "性能", "数据集", "框架", "模型", "消融", "准确率", "指标", "评测",
)
HSS_KEYWORDS = (
    "archive", "discourse", "ethnography", "historical", "history", "interview", "lens", "qualitative", "sociology", "theoretical", "theory",
    "公共领域", "制度", "劳动者", "历史", "口岸", "叙事", "档案", "民族志", "消费社会", "理论", "社会", "社科", "访谈", "论证", "通商", "零工", "革命", "视角", "阐释",
)
MOCK_STEM_KEYWORDS = ("machine learning", "dataset", "baseline", "experiment", "gnn", "transformer", "crystal", "accuracy", "metrics", "neural network")
MOCK_HSS_KEYWORDS = ("夏尔巴", "父系", "电影", "政治传播", "论点", "理论", "史料", "民族", "传播")

#: Node types by rank as root of a merged cluster (lower wins), and what other types have.
ROOT_PRIORITY = {
    "Thesis": 0, "ResearchQuestion": 0, "Method": 1, "Claim": 2, "Experiment": 3, "SubArgument": 4, "AnalyticalLens": 5,
    "IntellectualContext": 6, "Finding": 7, "Dataset": 8, "Metric": 9, "Baseline": 10, "Evidence": 11, "ObjectOrData": 12,
}
DEFAULT_ROOT_PRIORITY = 99
#: Cosine over which nodes of one type merge, by paradigm and kind of node; other types count as Concept.
MERGE_THRESHOLDS = {
    "STEM": {"Method": 0.92, "Dataset": 0.82, "Metric": 0.88, "Baseline": 0.88, "Concept": 0.88},
    "HSS": {"Method": 0.86, "Dataset": 0.80, "Concept": 0.82},
}
#: Cosine from which an isolated component is bridged, and the bridge's edge.
BRIDGE_THRESHOLD = 0.75
BRIDGE_TYPE, BRIDGE_LABEL = "SEMANTICALLY_RELATED_TO", "semantically_related"

#: Titles at which extraction chunks begin, by paradigm.
SECTION_TITLES = {
    "STEM": ["Abstract", "Introduction", "Related Work", "Background", "Preliminaries", "Methodology", "Methods", "Model", "Architecture", "Experiments", "Experimental Setup", "Results", "Evaluation", "Discussion", "Ablation Study", "Conclusion", "Conclusions", "References", "Acknowledgements", "Appendix"],
    "HSS": ["Abstract", "Introduction", "Literature Review", "Theoretical Framework", "Conceptual Framework", "Methodology", "Methods", "Data", "Analysis", "Findings", "Discussion", "Implications", "Conclusion", "Conclusions", "References", "Acknowledgements", "Appendix"],
}

#: What an empty section of a prompt reads, and the mark of a cut one.
EMPTY_ENTITIES = "（暂无向量召回实体，请依据上方图谱节点作答）"
EMPTY_RELATIONS = "（暂无向量召回关系）"
EMPTY_CHUNKS = "（暂无原文片段 — 论文向量索引尚未就绪或无匹配结果，请依据图谱节点与关系作答）"
CONTEXT_CUT = "…（检索上下文已截断，请优先依据上文与图谱节点作答）"

#: Cosine from which two papers' questions are alike, and where one of them is mostly English.
QUESTION_SIMILAR, QUESTION_SIMILAR_ENGLISH = 0.75, 0.55
#: An ASCII word, and the share of letters and digits over which such words make a label English.
ASCII_WORD, MOSTLY_ENGLISH = "[a-zA-Z]+", 0.5
#: Summaries of claim evolution where no model writes them.
SAME_QUESTION = "两篇论文围绕同一问题「%s」展开，建议进一步比对其结论、证据与实验设计差异。"
NEAR_QUESTIONS = "两篇论文分别关注「%s」与「%s」，研究问题存在相似性，建议对照结论与证据链进一步研判。"
BOTH_CLAIMS = "论文 A 的结论为「%s」，论文 B 的结论为「%s」，两者围绕相似问题给出了判断，建议结合证据链分析差异来源。"
ONLY_CLAIM_A = "论文 A 的结论为「%s」，论文 B 未检出明确结论。"
ONLY_CLAIM_B = "论文 B 的结论为「%s」，论文 A 未检出明确结论。"

#: Cosine from which methods are alike.
METHOD_SIMILAR = 0.88
