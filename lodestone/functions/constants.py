"""Fixed values that results depend on."""

CHUNK_SIZE, CHUNK_OVERLAP = 900, 120
DIMS = 384
MODEL_LABEL = f"local-hash-ngram-{DIMS}d"
EVIDENCE, RELATIVE_EVIDENCE = 0.16, 0.75
SEMANTIC_SHARE, KEYWORD_SHARE, FTS_SHARE = 0.48, 0.34, 0.18
DEFAULT_LIMIT, TERM_LIMIT, FTS_TERM_LIMIT = 5, 32, 16
CITATION_LENGTH, TITLE_LENGTH, SNIPPET_LENGTH, PROXY_SNIPPET_LENGTH, SUMMARY_LENGTH = 360, 160, 320, 300, 300
SUPPORTED = ("md", "docx", "pdf", "xlsx")
WEB_TIMEOUT_SECONDS = 8

# Question words that are never terms.
STOP_WORDS = ("什么", "哪些", "哪个", "如何", "怎么", "是否", "以及", "有关", "问题", "区别", "作用", "影响", "一下", "为什么", "是什么", "有哪些", "有什么", "请问", "和", "与", "及")
# Phrases left out of web queries, in the order they are removed.
WEB_STOP_PHRASES = ("是什么", "为什么", "有哪些", "有什么", "如何", "怎么", "是否", "请问", "用于", "用来", "进行", "实现", "可以")
# Headings that are no sentences, and beginnings of question sentences.
HEADINGS = ("摘要", "关键机制", "可回答的问题", "工作表 sheet1")
QUESTION_PREFIXES = ("什么", "哪些", "哪个", "如何", "怎么", "为什么")
# Traditional characters and their simplified forms, place by place.
TRADITIONAL = "與個為於這實現時無線網節點體傳統訊資數據聲稱幾後間關聯態變竊聽偵纏糾綜經學裏單獨純發應義"
SIMPLIFIED = "与个为于这实现时无线网节点体传统讯资数据声称几后间关联态变窃听侦缠纠综经学里单独纯发应义"
TRADITIONAL_PHRASES = {"通訊": "通信"}
# Terms that a question's words bring along.
SYNONYMS = (
    (("dioxide", "carbon"), (), ("二氧化碳", "碳固定")),
    (("pass through",), ("穿过", "介质"), ("travel", "through", "solids", "liquids", "gases", "pass through")),
)
# The two kinds of waves a question may compare, and what sentences on them say.
WAVE_QUESTION = ("p waves", "s waves")
WAVE_MARKS = ("P waves", "S waves", "travel through", "travel only through")
TERMINAL_MARKS = "。！？!?；;,.， "
SHEET_LABEL = "工作表 sheet"

# Markdown marks and what is put in their place, in order; \s is any white space.
MARKDOWN = (
    (r"\[+([^\]\[][^\]]*?|[^\]]+?)\]\([^)]+\)", "label"),
    (r"^[ \t]*#{1,6}[ \t]*", ""),
    (r"^[ \t]*[-*+]\s+", ""),
    (r"^[ \t]*\d+[.)]\s+", ""),
    (r"[*_`~]+", ""),
)

# Messages.
NO_EVIDENCE = "本地知识库没有找到足够依据。"
NO_INDEX = "本地知识库索引不存在，请先运行 ingest。"
NO_INDEX_REPORT = "本地知识库索引不存在，请先运行 ingest 或 rebuild。"
ANSWER_PREFIX = "根据本地知识库，"
WEB_PREFIX = "本地知识库没有找到足够依据，联网搜索到："
WEB_NOTHING = "已联网搜索，但没有找到可用结果。"
WEB_FAILED = "联网搜索失败："
WEB_HINT = "本地知识库没有足够依据。如需联网搜索，请追加 --web 参数。"
