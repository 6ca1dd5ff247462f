"""Text columns: hashes, token estimates, cutting, entities, similarity. All expressions stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
CJK = r"[\x{4E00}-\x{9FFF}]"
ASCII = r"[\x00-\x7F]"
UNITS = "元|美元|块|万|千|百|亿|%|％|度|kg|ml|GB|MB|TB"
NUMBER = rf"\d+(?:\.\d+)?(?:{UNITS})?"
NUMBER_WITH_UNIT = rf"\d+(?:\.\d+)?(?:{UNITS}|ms|秒|分钟|小时|天|周|月|年)"
PRELOAD_NUMBER = rf"\d+(?:\.\d+)?(?:{UNITS})"
CJK_NOUN = r"[\x{4E00}-\x{9FA5}]{2,4}(?:项目|系统|模块|功能|文件|配置|服务|数据|接口|版本)"
PROPER_NAME = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b|\b[A-Z]{2,}\b"
PROPER_NOUN = r"[A-Z][a-z]+|[\x{4E00}-\x{9FA5}]{2,4}(?:公司|项目|产品|版本|系统|模块)"
DATE = r"\d{4}[-/年]\d{1,2}[-/月]\d{1,2}[日]?|\d{1,2}月\d{1,2}日"
DATE_OR_DAY = DATE + "|昨天|今天|明天|上周|下周"
KEY_VERBS = ["决定", "选择", "购买", "设置", "配置", "修改", "删除", "创建", "安装", "更新"]
ENTITY_STOPWORDS = ["这个", "那个", "什么", "怎么", "如何", "为什么", "是不是", "有没有", "可以", "能够", "需要", "应该"]
PRELOAD_STOPWORDS = ["这个", "那个", "什么", "怎么"]
QUERY_STOPWORDS = [
    "好", "好的", "嗯", "哦", "是", "对", "行", "可以", "继续", "明白", "知道了", "谢谢", "感谢", "不客气", "再见", "拜拜",
    "ok", "yes", "no", "hi", "hello", "hey",
]
QUERY_TYPES = [
    ("time_related", "昨天|今天|上周|之前|刚才|什么时候|何时|when|yesterday|today|before"),
    ("factual", "是什么|什么是|怎么|如何|为什么|谁|哪|what|how|why|who|which"),
    ("casual", "你好|嗨|哈喽|谢谢|再见|ok|好的|嗯|hello|hi|thanks|bye"),
]
MODEL_TOKENS = {"gpt-4": 8192, "gpt-4-turbo": 128000, "gpt-3.5-turbo": 4096, "claude-3": 200000, "gemini-1.5": 1000000, "default": 4096}
RESERVED = ["AND", "OR", "NOT", "NEAR", "COLUMN"]
DENSE_PHRASES = ["流程图", "时序图", "架构图", "状态机", "数据流", "ER图", "类图", "部署图", "网络拓扑", "API接口", "数据库设计", "系统设计", "技术方案"]
CODE = r"```[\s\S]*?```|``[\s\S]*?``|`[^`]+`|def\s+\w+\s*\(|class\s+\w+|function\s+\w+|import\s+\w+|from\s+\w+\s+import"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, f) -> Column:
    """``f`` of a value that is made once, however often ``f`` refers to it."""
    return F.transform(F.array(value), f)[0]


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def text_hash(x) -> Column:
    """Key of idempotent inserts."""
    return F.substring(F.sha2(_c(x), 256), 1, 32)


def content_hash(x) -> Column:
    return F.substring(F.md5(_c(x)), 1, 16)


def vector_content_hash(x) -> Column:
    """Of the text without outer white space and case."""
    bare = F.regexp_replace(F.regexp_replace(_c(x), r"(?U)^\s+", ""), r"(?U)\s+$", "")
    return F.substring(F.sha2(F.lower(bare), 256), 1, 16)


def vector_id(x) -> Column:
    return F.concat(F.lit("mem_"), text_hash(x))


def l1_key(record_id, temp_id) -> Column:
    return F.coalesce(F.concat(F.lit("sqlite_"), _c(record_id).cast("string")), F.concat(F.lit("temp_"), _c(temp_id).cast("string")))


def tokens(x) -> Column:
    """Estimate: 1.2 a CJK character, 0.3 an ASCII one, 0.5 any other, rounded down. Null and empty are 0."""
    x = F.coalesce(_c(x), F.lit(""))
    cjk, ascii_ = F.regexp_count(x, F.lit(CJK)), F.regexp_count(x, F.lit(ASCII))
    other = F.length(x) - cjk - ascii_
    return F.floor(cjk * F.lit(1.2) + ascii_ * F.lit(0.3) + other * F.lit(0.5)).cast("long")


def model_limit(model) -> Column:
    known = F.create_map(*(F.lit(y) for pair in MODEL_TOKENS.items() for y in pair))
    return F.coalesce(F.try_element_at(known, _c(model)), F.lit(MODEL_TOKENS["default"]))


def tokens_with_limit(x, model) -> Column:
    """struct(n, over, most)."""
    n, most = tokens(x), model_limit(model)
    return F.struct(n.alias("n"), (n > most).alias("over"), most.alias("most"))


def fits(x, model, buffer: int = 100) -> Column:
    return tokens(x) <= model_limit(model) - buffer


def truncate_tokens(x, most: int, suffix: str = "...") -> Column:
    """The text if it fits, else the prefix that the text's own characters a token allow, and the suffix."""
    x = _c(x)
    n = tokens(x)
    room = F.floor((F.lit(most) - len(suffix)) * F.length(x) / F.greatest(n, F.lit(1))).cast("int")
    return F.when(n <= most, x).otherwise(F.concat(F.substring(x, F.lit(1), F.greatest(room, F.lit(0))), F.lit(suffix)))


def _last(x: Column, mark: str) -> Column:
    """0-based position of the last ``mark``, -1 if there is none."""
    back = F.instr(F.reverse(x), mark)
    return F.when(back > 0, F.length(x) - back).otherwise(-1)


def smart_truncate(x, most: int) -> Column:
    """The beginning, cut after a sentence if one ends in its second half, and up to three numbers and two dates."""
    x, chars = _c(x), most // 2 - 20
    if chars <= 0:
        return F.concat(F.substring(x, 1, 50), F.lit("..."))
    numbers = F.regexp_extract_all(x, F.lit(NUMBER), F.lit(0))
    dates = F.regexp_extract_all(x, F.lit(DATE), F.lit(0))
    key = F.concat(F.slice(numbers, 1, 3), F.slice(dates, 1, 2))
    head = F.substring(x, 1, chars)
    stop = F.greatest(*(_last(head, m) for m in "。.！？"))
    cut = F.when(stop > chars * 0.5, F.substring(head, F.lit(1), stop + 1)).otherwise(head)
    return F.concat(cut, F.when(F.size(key) > 0, F.concat(F.lit(" | 关键信息: "), F.array_join(key, ", "))).otherwise(""), F.lit("..."))


def truncate_input(x, most: int, mark: str = "...") -> Column:
    x = _c(x)
    if most <= 0:
        return F.lit("")
    return F.when(tokens(x) <= most, x).otherwise(F.concat(F.substring(x, 1, most // 2), F.lit(mark)))


def phrase_query(x) -> Column:
    """A quoted phrase without reserved words and at most 500 characters; ``""`` for nothing but symbols."""
    x = F.coalesce(_c(x), F.lit(""))
    words = F.filter(F.split(F.trim(F.regexp_replace(x, r"\s+", " ")), " "), lambda w: (w != "") & ~F.array_contains(strings(RESERVED), F.upper(w)))
    body = F.substring(F.replace(F.array_join(words, " "), F.lit('"'), F.lit('""')), 1, 500)
    empty = (x == "") | x.rlike(r"(?U)^[\s\W]+$") | (F.size(words) == 0)
    return F.when(empty, F.lit('""')).otherwise(F.concat(F.lit('"'), body, F.lit('"')))


def words(x) -> Column:
    """Distinct lower-case words between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(_c(x)), r"\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def char_jaccard(a, b) -> Column:
    chars = lambda x: F.array_distinct(F.filter(F.split(_c(x), ""), lambda c: c != ""))
    return jaccard(chars(a), chars(b))


def word_jaccard(a, b) -> Column:
    return jaccard(words(a), words(b))


def keyword_similarity(keywords: Column, x) -> Column:
    """Coverage, position of the first hits and word length, in [0, 1]."""
    x, n = _c(x), F.size(keywords)
    hits = F.filter(keywords, lambda k: F.contains(x, k))
    place = F.aggregate(hits, F.lit(0.0), lambda s, k: s + F.when(F.position(k, x) <= 100, 1.0).when(F.position(k, x) <= 300, 0.7).otherwise(0.5))
    idf = F.aggregate(hits, F.lit(0.0), lambda s, k: s + F.when(F.length(k) > 3, 1.5).otherwise(1.0))
    total = F.size(hits) / n * 0.5 + place / n * 0.3 + idf / (n * 1.5) * 0.2
    return F.when((n > 0) & (F.length(x) > 0), F.least(total, F.lit(1.0))).otherwise(0.0)


def entities(x) -> Column:
    """Distinct names, nouns and quantities, sorted."""
    found = F.array_union(F.array_union(*(F.regexp_extract_all(_c(x), F.lit(p), F.lit(0)) for p in (CJK_NOUN, PROPER_NAME))), F.regexp_extract_all(_c(x), F.lit(NUMBER_WITH_UNIT), F.lit(0)))
    return F.array_sort(F.array_except(found, strings(ENTITY_STOPWORDS)))


def expand_query(x, history_entities: Column, most: int = 5) -> Column:
    """The query and up to five entities of the last turns that it doesn't hold, in alphabetical order."""
    more = F.slice(F.array_sort(F.array_except(F.array_distinct(history_entities), entities(x))), 1, most)
    return F.when(F.size(more) > 0, F.concat(_c(x), F.lit(" "), F.array_join(more, " "))).otherwise(_c(x))


def preload_keywords(x) -> Column:
    x = F.coalesce(_c(x), F.lit(""))
    take = lambda p, n: F.slice(F.regexp_extract_all(x, F.lit(p), F.lit(0)), 1, n)
    named = F.concat(take(CJK_NOUN, 3), take(PROPER_NAME, 2), take(PRELOAD_NUMBER, 2))
    plain = F.slice(F.filter(F.split(x, r"\s+"), lambda w: (F.length(w) > 1) & ~F.array_contains(strings(PRELOAD_STOPWORDS), w)), 1, 5)
    return F.array_join(F.when(F.size(named) > 0, named).otherwise(plain), " ")


def importance(x) -> Column:
    """Numbers count 2, proper nouns and dates 1.5, each key verb that occurs 1."""
    x = F.coalesce(_c(x), F.lit(""))
    verbs = sum((F.contains(x, F.lit(v)).cast("int") for v in KEY_VERBS), F.lit(0))
    count = lambda p: F.regexp_count(x, F.lit(p))
    return count(NUMBER) * 2.0 + count(PROPER_NOUN) * 1.5 + verbs + count(DATE_OR_DAY) * 1.5


def repetitive(x, threshold: float = 0.7) -> Column:
    """One character makes up over ``threshold`` of a text of five characters at least."""
    x = F.coalesce(_c(x), F.lit(""))
    chars = F.filter(F.split(x, ""), lambda c: c != "")
    most = F.array_max(F.transform(F.array_distinct(chars), lambda d: F.length(x) - F.length(F.replace(x, d, F.lit("")))))
    return (F.length(x) >= 5) & F.coalesce(most / F.length(x) > threshold, F.lit(False))


def query_type(x) -> Column:
    low = F.lower(_c(x))
    out = F.when(low.rlike(QUERY_TYPES[0][1]), QUERY_TYPES[0][0])
    for name, pattern in QUERY_TYPES[1:]:
        out = out.when(low.rlike(pattern), name)
    marks = (F.regexp_count(_c(x), F.lit(r"\?")) > 1) | (F.regexp_count(_c(x), F.lit("？")) > 1)
    return out.when((F.length(_c(x)) > 100) | marks, "complex").otherwise("default")


def valid_query(x) -> Column:
    x = F.trim(F.coalesce(_c(x), F.lit("")))
    return (F.length(x) >= 2) & ~F.lower(x).isin(QUERY_STOPWORDS) & x.rlike(r"[\x{4E00}-\x{9FA5}a-zA-Z0-9]")


def dense(x) -> Column:
    """Diagrams, designs and code."""
    x = F.coalesce(_c(x), F.lit(""))
    found = x.rlike(CODE)
    for p in DENSE_PHRASES:
        found = F.contains(x, F.lit(p)) | found
    return found


def valid_url(x) -> Column:
    """https, or http on the own machine."""
    x = F.lower(F.trim(F.coalesce(_c(x), F.lit(""))))
    return x.rlike(r"^https://[^/\s]+") | x.rlike(r"^http://(localhost|127\.0\.0\.1)(:\d+)?(/|$)")


#: Patterns of access keys by provider.
KEYS = {"openai": r"^sk-[A-Za-z0-9_-]+$", "gemini": r"^[A-Za-z0-9_-]+$", "glm": r"^[A-Za-z0-9._-]+$"}
LEAST_KEY = 20


def valid_key(provider, key) -> Column:
    """Whether a key has its provider's form and length. Of an unknown provider any key does, but not none."""
    key, provider = F.coalesce(_c(key), F.lit("")), F.lower(_c(provider))
    out = F.when(key == "", False)
    for name, pattern in KEYS.items():
        out = out.when(provider == name, (F.length(key) >= LEAST_KEY) & key.rlike(pattern))
    return out.otherwise(True)


def chunks(x, most: int = 3000) -> Column:
    """The lines of a text packed into pieces of at most ``most`` characters, line ends not counted; a longer line is a piece
    of its own."""
    lines = F.split(F.coalesce(_c(x), F.lit("")), "\n")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"), F.lit(0).alias("n"))

    def add(state, line):
        full = state["now"].isNotNull() & (state["n"] + F.length(line) > most)
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(state["now"]))).otherwise(state["done"]).alias("done"),
            F.when(full | state["now"].isNull(), line).otherwise(F.concat(state["now"], F.lit("\n"), line)).alias("now"),
            F.when(full | state["now"].isNull(), F.length(line)).otherwise(state["n"] + F.length(line)).cast("int").alias("n"),
        )

    return F.aggregate(lines, start, add, lambda s: F.when(s["now"].isNotNull(), F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]))


def numbered(lines: Column) -> Column:
    """The texts of an array as a numbered list, for a prompt."""
    return F.array_join(F.transform(lines, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t)), "\n")


def prompt(template: str, **parts) -> Column:
    """A prompt: ``{name}`` in the template gives way to the column of that name; null parts are empty."""
    out = F.lit(template)
    for name, part in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(_c(part), F.lit("")))
    return out


def uptime(seconds) -> Column:
    s = _c(seconds).cast("long")
    return F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm %ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%dh %dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))


# vectors


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def normalised(a) -> Column:
    length = F.sqrt(dot(a, a))
    return F.transform(_c(a), lambda x: x.cast("double") / length)


def vector_entropy(a) -> Column:
    """Shannon entropy of the shares of the absolute values, over its largest value."""
    total = F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + F.abs(x) + 1e-10)
    terms = F.transform(_c(a), lambda x: (F.abs(x) + 1e-10) / total)
    return F.aggregate(terms, F.lit(0.0), lambda s, p: s - p * F.log2(p + 1e-10)) / F.log2(F.size(_c(a)))


def information_density(a) -> Column:
    """From mean, deviation and entropy, twice their weighted sum, in [0, 1]."""
    a, n = _c(a), F.size(_c(a))
    mean_abs = F.aggregate(a, F.lit(0.0), lambda s, x: s + F.abs(x)) / n
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / n
    spread = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (mean_abs * 0.3 + spread * 0.4 + vector_entropy(a) * 0.3) * 2.0))
