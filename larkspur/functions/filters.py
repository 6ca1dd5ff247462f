"""Noise, privacy and quality filters as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CONFIG, Config
from .text import _c, information_density, let, repetitive, strings

# Fixed values that results depend on.
PROTECTED = [
    r"不[，,]?\s*是", r"不对[，,]?\s*", r"不对\s*\d+", r"更正[：:，,]?\s*", r"更正一下[是为]?\s*", r"纠正[一下]?\s*[是为]?\s*",
    r"其实是[是为]?\s*", r"记错[了]?\s*[是为]?\s*", r"应该是[是为]?\s*", r"搞错[了]?\s*[是为]?\s*", r"弄错[了]?\s*[是为]?\s*",
    r"说错[了]?\s*[是为]?\s*", r"写错[了]?\s*[是为]?\s*", r"刚才[是为]?\s*", r"之前[是为]?\s*",
    r"\d+(?:\.\d+)?(?:元|美元|块|万|千|百|亿|%|％|度|kg|ml|GB|MB|TB|cm|mm|m|km)", r"\d{4}[-/年]\d{1,2}[-/月]\d{1,2}", r"\d{1,2}:\d{2}",
    r"是\s*\d+", r"等于\s*\d+", r"总共\s*\d+", r"共\s*\d+", r"花了\s*\d+", r"买了\s*\d+", r"设置[为到]\s*\d+", r"配置[为到]\s*\d+",
    r"太[棒好美赞酷厉害]了", r"非常[棒好美赞酷厉害]", r"[最很特别]+[棒好美赞酷厉害]", r"[不没]错", r"等等[，,]?", r"还有[，,]?",
    r"注意[：:]?", r"警告[：:]?", r"重要[：:]?",
]
EMOTION = [
    "太棒了", "太好了", "太美了", "太赞了", "太酷了", "太厉害了", "非常好", "很好", "极好", "优秀", "出色",
    "喜欢", "爱", "推荐", "建议", "不满意", "不喜欢", "问题", "错误", "bug",
]
TEMPLATES = [
    "嗯", "哦", "啊", "哈", "好", "行", "对", "是", "没错", "对的", "嗯嗯", "哦哦", "啊啊", "哈哈", "呵呵", "嘿嘿", "好的", "好吧", "行了",
    "知道了", "明白了", "了解了", "清楚了", "懂了", "收到", "好的知道了", "好的明白了", "我知道了", "我明白了",
    "然后呢", "接着呢", "还有吗", "继续说", "讲下去", "你说得对", "有道理", "确实如此", "没错没错", "赞同",
    "哈哈哈", "哈哈哈哈", "笑死", "太搞笑了", "绝了", "重复一下问题", "再说一遍", "我没听清", "你刚才说什么",
]
KEYWORDS = [
    "嗯", "哦", "啊", "哈", "嘻", "嘿", "哼", "嗯嗯", "哦哦", "啊啊", "哈哈", "呵呵", "嘿嘿",
    "好的", "好吧", "行了", "可以", "对", "是的", "没错", "对的", "知道了", "明白了", "了解了", "清楚了", "懂了", "收到",
    "好的知道了", "好的明白了", "我知道了", "我明白了", "然后呢", "接着呢", "还有吗", "继续说", "讲下去",
    "你说得对", "有道理", "确实如此", "没错没错", "赞同", "哈哈哈", "哈哈哈哈", "笑死", "太搞笑了", "绝了",
    "重复一下问题", "再说一遍", "我没听清", "你刚才说什么",
]
INTERJECTIONS = "嗯哦啊哈嘻嘿哼呵"
PATTERNS = [
    r"^[嗯哦啊哈嘻嘿嗯哼]+[。！]?$", r"^[好的行对是嗯晓得]+[。！]?$", r"^[哈哈呵呵嘿嘿]+[。！]?$", r"^[\s\n\r]*$",
    r"""^[0-9\s!@#$%^&*()_+\-=\[\]{};':"\\|,.<>/?]+$""",
]
#: Ranges of pictographs. The circled-letter range ends before the scripts of East Asia.
EMOJI = r"^[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}\x{1F170}-\x{1F251}]+$"


def protected(x) -> Column:
    """Corrections, quantities, dates and feelings are never noise."""
    x = F.coalesce(_c(x), F.lit(""))
    return x.rlike("|".join(PROTECTED)) | x.rlike("|".join(EMOTION))


def pure_emoji(x) -> Column:
    return F.coalesce(_c(x), F.lit("")).rlike(EMOJI)


def noise(user, assistant, embedding=None, template_similarity=None, config: Config = CONFIG, templates: list[str] | None = None) -> Column:
    """struct(is_noise, reason, confidence, storage) of a turn.

    In this order: protected, exact template, rules, and for turns shorter than twice the length limit the information
    density of ``embedding`` and the largest similarity to a template, a column made beforehand. Rules look at the contents of the turn, not at
    its labels. Storage is full, sqlite_only or, for confidence over 0.9, discard.
    """
    bare = [F.trim(F.coalesce(_c(c), F.lit(""))) for c in (user, assistant)]
    density = information_density(embedding) if embedding is not None else None
    parts = F.struct(bare[0].alias("user"), bare[1].alias("assistant"), F.concat(*bare).alias("both"))
    return let(parts, lambda p: _noise(p["user"], p["assistant"], p["both"], density, template_similarity, config, templates or TEMPLATES))


def _verdict(is_noise: bool, reason: str, confidence, storage) -> Column:
    column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(F.lit(is_noise).alias("is_noise"), F.lit(reason).alias("reason"), column(confidence).cast("double").alias("confidence"), column(storage).alias("storage"))


def _noise(user: Column, assistant: Column, both: Column, density, template_similarity, config: Config, templates: list[str]) -> Column:
    rule = (
        F.when(both == "", 0.99)
        .when(F.length(both) <= 2, 0.95)
        .when(user.isin(KEYWORDS) | assistant.isin(KEYWORDS), 0.9)
        .when(both.rlike(f"^[{INTERJECTIONS}]+$"), 0.9)
        .when(both.rlike("|".join(PATTERNS)), 0.85)
        .when(pure_emoji(both), 0.85)
        .when(repetitive(both), 0.8)
    )
    by_rule = let(rule, lambda c: F.when(c.isNotNull(), _verdict(True, "rule", c, F.when(c > 0.9, "discard").otherwise("sqlite_only"))))
    short = F.length(both) < config.noise_length * 2
    layers = [F.when(protected(both), _verdict(False, "protected", 0.0, "full")), F.when(user.isin(templates), _verdict(True, "template", 0.99, "discard")), by_rule]
    if density is not None:
        least = F.when(F.length(both) < 15, 0.08).otherwise(config.noise_density) * F.when(both.rlike(r"\d"), 0.6).otherwise(1.0)
        layers.append(let(density, lambda d: F.when(short & (d < least), _verdict(True, "density", 1 - d, "sqlite_only"))))
    if template_similarity is not None:
        s = _c(template_similarity)
        layers.append(F.when(short & (s > config.noise_similarity), _verdict(True, "similarity", s, "sqlite_only")))
    return F.coalesce(*layers, _verdict(False, "passed", 0.0, "full"))


def template_similarity(embedding, templates: np.ndarray) -> Column:
    """The largest dot product of a vector with those of the noise templates, a bounded list: a matrix of a row each."""

    @F.pandas_udf("double")
    def most(vectors: pd.Series) -> pd.Series:
        if not len(vectors) or not len(templates):
            return pd.Series([None] * len(vectors), dtype=float)
        return pd.Series((np.stack(vectors) @ templates.T).max(1).astype(float))

    return most(_c(embedding))


def worth_storing(user, assistant) -> Column:
    return ~noise(user, assistant)["is_noise"]


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    replacement: str
    enabled: bool = True


_GAP = r"[\s\-－—　]?"
# Patterns and masks of personal data, applied in this order.
RULES = [
    Rule("phone", rf"(?:\+?86{_GAP})?(1[3-9]\d){_GAP}(\d{{4}}){_GAP}(\d{{4}})", "$1****$3"),
    Rule("id_card", rf"(\d{{6}}){_GAP}(\d{{4}}\d{{2}}\d{{2}}){_GAP}(\d{{3}}[\dXx])", "$1********$3"),
    Rule("email", r"[\w.+-]+@[\w.-]+\.\w+", "***@***.***"),
    Rule("bank_card", rf"(?<!\d)(\d{{4}}){_GAP}\d{{4}}{_GAP}\d{{1,3}}{_GAP}\d{{1,4}}{_GAP}(\d{{4}})(?!\d)", "$1 **** **** $2"),
    Rule("password", r"((?:密码|password|pwd|pass|口令)[是为：:＝]\s*)[\w!@#$%^&*()\-+=]{6,20}(?!\w)", "$1****"),
    Rule("api_key", r"(?:sk-[a-zA-Z0-9]{20,}|api[_-]?key[_-]?[a-zA-Z0-9]{16,}|secret[_-]?[a-zA-Z0-9]{16,})", "****"),
    Rule("credit_card", rf"(?<!\d)(\d{{4}}){_GAP}\d{{4}}{_GAP}\d{{4}}{_GAP}(\d{{4}})(?!\d)", "$1 **** **** $2"),
    Rule("ipv4", r"(?<!\d)(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})(?!\d)", "$1.***.***.$4"),
]


def configure(rules: list[Rule] = RULES, enable: dict[str, bool] | None = None, custom: list[Rule] | None = None) -> list[Rule]:
    """The rules with some switched on or off, and custom ones at the end."""
    enable = enable or {}
    return [Rule(r.name, r.pattern, r.replacement, enable.get(r.name, r.enabled)) for r in rules] + list(custom or [])


def detect_counts(x, rules: list[Rule] = RULES) -> list[Column]:
    """A count column for each rule, on the original text."""
    return [F.regexp_count(F.coalesce(_c(x), F.lit("")), F.lit(r.pattern)).cast("long").alias(f"n_{r.name}") for r in rules if r.enabled]


def mask(x, rules: list[Rule] = RULES, excluded: list[str] | None = None) -> Column:
    """The text with each rule's finds masked, rule after rule. A text with an excluded keyword stays. Null is null."""
    out = _c(x)
    for r in rules:
        if r.enabled:
            out = F.regexp_replace(out, r.pattern, r.replacement)
    if excluded:
        out = F.when(F.exists(strings(excluded), lambda k: F.contains(_c(x), k)), _c(x)).otherwise(out)
    return out


def mask_map(x, rules: list[Rule] = RULES) -> Column:
    """The same for the values of a map of strings."""
    return F.transform_values(_c(x), lambda _, v: mask(v, rules))


def mask_nested(x: Column, kind: T.DataType, rules: list[Rule] = RULES, excluded: list[str] | None = None) -> Column:
    """A value of any type with every string in it masked: in structs, arrays and values of maps, however deep. Keys of maps
    and what isn't text stay; null stays null. One expression, made from the type."""
    if isinstance(kind, T.StringType):
        return mask(x, rules, excluded)
    if not _holds_text(kind):
        return x
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda v: mask_nested(v, kind.elementType, rules, excluded))
    if isinstance(kind, T.MapType):
        return F.transform_values(x, lambda _, v: mask_nested(v, kind.valueType, rules, excluded))
    fields = F.struct(*(mask_nested(x.getField(f.name), f.dataType, rules, excluded).alias(f.name) for f in kind.fields))
    return F.when(x.isNotNull(), fields)


def _holds_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds_text(kind.elementType)
    if isinstance(kind, T.MapType):
        return _holds_text(kind.valueType)
    return any(_holds_text(f.dataType) for f in kind.fields) if isinstance(kind, T.StructType) else isinstance(kind, T.StringType)


def mask_rows(df: DataFrame, rules: list[Rule] = RULES, excluded: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """``df`` with every string in every column masked, but for the columns ``keep``."""
    return df.select(*(F.col(f.name) if f.name in (keep or []) else mask_nested(F.col(f.name), f.dataType, rules, excluded).alias(f.name) for f in df.schema.fields))


def detect(x, rules: list[Rule] = RULES) -> Column:
    """map(rule -> masked finds) of the rules that find something."""
    active = [r for r in rules if r.enabled]
    finds = [F.transform(F.regexp_extract_all(F.coalesce(_c(x), F.lit("")), F.lit(r.pattern), F.lit(0)), lambda m: F.concat(F.substring(m, 1, 3), F.lit("***"))) for r in active]
    whole = F.map_from_arrays(strings([r.name for r in active]), F.array(*finds))
    return F.map_filter(whole, lambda _, v: F.size(v) > 0)
