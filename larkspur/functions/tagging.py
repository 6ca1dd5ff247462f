"""Rule tags of a text, and how tags are merged."""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import _c, let, strings

# Fixed values that results depend on: keywords by category; a keyword named twice counts twice.
CATEGORIES = {
    "work": ["工作", "会议", "项目", "报告", "任务", "deadline", "加班", "同事", "老板", "客户", "邮件", "ppt", "演示", "汇报", "work", "meeting", "project", "report", "deadline", "office"],
    "life": ["生活", "日常", "家里", "做饭", "购物", "家务", "快递", "外卖", "超市", "周末", "假期", "休息", "生活", "life", "home", "shopping", "weekend"],
    "study": ["学习", "课程", "考试", "作业", "笔记", "复习", "预习", "学校", "老师", "同学", "论文", "研究", "study", "learn", "course", "exam", "homework", "school", "university"],
    "health": ["健康", "医院", "医生", "吃药", "体检", "运动", "健身", "减肥", "睡眠", "头痛", "感冒", "预约", "门诊", "health", "hospital", "doctor", "exercise", "gym"],
    "finance": ["钱", "工资", "转账", "还款", "账单", "投资", "理财", "银行", "信用卡", "花呗", "借呗", "余额", "存款", "money", "salary", "bank", "invest", "finance", "payment"],
    "tech": ["代码", "编程", "bug", "开发", "部署", "服务器", "数据库", "api", "git", "python", "java", "javascript", "框架", "code", "programming", "develop", "server", "database"],
    "entertainment": ["电影", "游戏", "音乐", "小说", "追剧", "综艺", "动漫", "演唱会", "旅游", "美食", "餐厅", "电影票", "movie", "game", "music", "entertainment", "fun"],
    "travel": ["旅游", "旅行", "机票", "酒店", "景点", "签证", "护照", "出差", "高铁", "飞机", "行程", "目的地", "travel", "trip", "flight", "hotel", "vacation"],
    "relationship": ["朋友", "家人", "父母", "孩子", "老公", "老婆", "男朋友", "女朋友", "生日", "纪念日", "结婚", "聚会", "friend", "family", "parents", "relationship", "love"],
}
HIGH = ["紧急", "重要", "必须", "务必", "千万", "deadline", "urgent", "important", "critical", "不要忘", "一定要", "绝对", "务必"]
LOW = ["随便", "无所谓", "不重要", "可选", "有空", "optional", "maybe", "whenever", "不急"]
TIME = [
    r"明天", r"后天", r"下周", r"下个月", r"周末", r"今天", r"昨天", r"前天", r"上周", r"上个月", r"\d+月\d+日", r"\d+号", r"\d+点", r"\d+:\d+",
    r"tomorrow", r"yesterday", r"next week", r"today", r"上午", r"下午", r"晚上", r"早上", r"中午",
]
POSITIVE = ["开心", "高兴", "喜欢", "棒", "好", "成功", "完成", "解决", "谢谢", "感谢", "满意", "happy", "great", "good", "nice", "love", "thanks"]
NEGATIVE = ["烦", "讨厌", "累", "难过", "失败", "问题", "错误", "麻烦", "担心", "焦虑", "压力", "sad", "angry", "tired", "bad", "hate", "worry"]
ENTITIES = [
    (r"([\x{4E00}-\x{9FA5}]{2,3})(说|告诉|问|让|请|帮)", 1),
    (r"(同事|朋友|老师|医生|老板)([\x{4E00}-\x{9FA5}]{2,3})?", 1),
    (r"在([\x{4E00}-\x{9FA5}]{2,10})(工作|生活|学习|出差)", 1),
    (r"去([\x{4E00}-\x{9FA5}]{2,10})(旅游|出差|开会)", 1),
    (r"(\d{4}年\d{1,2}月\d{1,2}日)", 1),
    (r"(\d{1,2}月\d{1,2}[日号])", 1),
    (r"(明天|后天|下周[一二三四五六日]?)", 1),
]
RANK = {"high": 3, "medium": 2, "low": 1}
MOST_ENTITIES, MOST_TOPICS = 10, 5


_EVERY = list(dict.fromkeys(k for ks in CATEGORIES.values() for k in ks))
#: Words of time that hold no pattern, and the others.
_TIME_WORDS, _TIME_PATTERN = [t for t in TIME if "\\" not in t], "|".join(t for t in TIME if "\\" in t)
_WANTED = list(dict.fromkeys([*_EVERY, *HIGH, *LOW, *_TIME_WORDS, *POSITIVE, *NEGATIVE]))


@functools.lru_cache(1)
def _automaton():
    """Finds all key words in one pass over a text, also those that overlap or lie in others."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for i, word in enumerate(_WANTED):
        out.add_word(word, i)
    out.make_automaton()
    return out


#: Texts that are Python's at a time.
_AT_ONCE = 64


@F.arrow_udf(T.ArrayType(T.StringType()))
def _words_in(texts: pa.Array) -> pa.Array:
    words, found = _automaton(), []
    for at in range(0, len(texts), _AT_ONCE):
        found += [sorted({i for _, i in words.iter(t)}) for t in texts.slice(at, _AT_ONCE).to_pylist()]
    starts = pa.array(np.cumsum([0, *map(len, found)], dtype=np.int32))
    return pa.ListArray.from_arrays(starts, pa.array(_WANTED).take(pa.array([i for x in found for i in x], pa.int32())))


def _lower(x) -> Column:
    return F.lower(F.coalesce(_c(x), F.lit("")))


def _in(x, f) -> Column:
    """``f`` of the key words that occur in a text, each once, in the order of the lists."""
    return let(_words_in(_lower(x)), f)


def _of_categories(found: Column) -> Column:
    return F.array_intersect(found, strings(_EVERY))


def _category_of(found: Column) -> Column:
    def score(keywords):
        once = F.size(F.array_intersect(found, strings(list(dict.fromkeys(keywords)))))
        twice = [k for k in dict.fromkeys(keywords) if keywords.count(k) > 1]
        return once + F.size(F.array_intersect(found, strings(twice))) if twice else once

    scores = [F.struct(score(keywords).alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, keywords) in enumerate(CATEGORIES.items())]
    return let(F.array_max(F.array(*scores)), lambda s: F.when(s["score"] == 0, F.lit("other")).otherwise(s["name"]))


def category(x) -> Column:
    """The category with most keywords, the first of equals; other if there is none."""
    return _in(x, _category_of)


def _any(found: Column, words: list[str]) -> Column:
    return F.arrays_overlap(found, strings(list(dict.fromkeys(words))))


def _importance(found: Column) -> Column:
    return F.when(_any(found, HIGH), "high").when(_any(found, LOW), "low").otherwise("medium")


def _sentiment(found: Column) -> Column:
    count = lambda words: F.size(F.array_intersect(found, strings(words)))
    return let(count(POSITIVE) - count(NEGATIVE), lambda n: F.when(n > 0, "positive").when(n < 0, "negative").otherwise("neutral"))


def importance(x) -> Column:
    return _in(x, _importance)


def sentiment(x) -> Column:
    """By the number of different patterns that occur."""
    return _in(x, _sentiment)


def time_sensitive(x) -> Column:
    return _in(x, lambda found: _any(found, _TIME_WORDS)) | _lower(x).rlike(_TIME_PATTERN)


def entities(x) -> Column:
    x = F.coalesce(_c(x), F.lit(""))
    found = F.concat(*(F.regexp_extract_all(x, F.lit(p), F.lit(g)) for p, g in ENTITIES))
    return F.slice(F.array_distinct(F.filter(found, lambda e: F.length(e) >= 2)), 1, MOST_ENTITIES)


def _topics_of(found: Column) -> Column:
    return F.slice(_of_categories(found), 1, MOST_TOPICS)


def topics(x) -> Column:
    return _in(x, _topics_of)


def rule_tag(x) -> Column:
    """struct(category, importance, sentiment, entities, time_sensitive, topics, source, confidence). All key words are looked
    for in one pass."""
    parts = F.struct(_words_in(_lower(x)).alias("found"), _lower(x).rlike(_TIME_PATTERN).alias("timed"), entities(x).alias("entities"))

    def fields(p):
        found = p["found"]
        return F.struct(
            _category_of(found).alias("category"), _importance(found).alias("importance"), _sentiment(found).alias("sentiment"), p["entities"].alias("entities"),
            (_any(found, _TIME_WORDS) | p["timed"]).alias("time_sensitive"), _topics_of(found).alias("topics"), F.lit("rule").alias("source"),
        )

    def sure(t):
        more = [(t["category"] != "other", 0.2), (t["importance"] != "medium", 0.1), (t["sentiment"] != "neutral", 0.1), (t["time_sensitive"], 0.1)]
        return t.withField("confidence", F.round(sum((F.when(c, w).otherwise(0.0) for c, w in more), F.lit(0.5)), 6))

    return let(let(parts, fields), sure)


def with_veto(merged: DataFrame, tagged: DataFrame, key: str, order: str) -> DataFrame:
    """``merged`` (``merge_tags``) with the category of the first tag that a user has corrected, which no majority overrules."""
    own = tagged.where(F.col("tag.source") == "user").groupBy(key).agg(F.min_by("tag.category", order).alias("__own"))
    return merged.join(own, key, "left").withColumn("category", F.coalesce("__own", "category")).drop("__own")


def merge_tags(tagged: DataFrame, key: str, order: str) -> DataFrame:
    """One tag for each ``key`` from rows with a struct ``tag``: the most frequent category and sentiment, the first of
    equals, the highest importance, any time sensitivity, the mean confidence, and the first distinct entities and topics.

    Majorities are counted by group and value first, so a hot key is one row for each value and task.
    """
    def most(field: str) -> DataFrame:
        counts = tagged.groupBy(key, F.col(f"tag.{field}").alias("v")).agg(F.count("*").alias("n"), F.min(order).alias("at"))
        return counts.groupBy(key).agg(F.max_by("v", F.struct("n", -F.col("at"))).alias(field))

    def firsts(field: str, limit: int) -> DataFrame:
        seen = tagged.select(key, order, F.posexplode(f"tag.{field}").alias("pos", "v"))
        once = seen.groupBy(key, "v").agg(F.min(F.struct(order, "pos")).alias("at"))
        from pyspark.sql import Window

        ranked = once.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("at"))).where(F.col("r") <= limit)
        return ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda s: s["v"]).alias(field))

    rank = F.create_map(*(F.lit(y) for pair in RANK.items() for y in pair))
    back = F.create_map(*(F.lit(y) for name, r in RANK.items() for y in (r, name)))
    rest = tagged.groupBy(key).agg(back[F.max(rank[F.col("tag.importance")])].alias("importance"), F.bool_or("tag.time_sensitive").alias("time_sensitive"), F.avg("tag.confidence").alias("confidence"))
    out = rest.join(most("category"), key).join(most("sentiment"), key)
    for field, limit in (("entities", MOST_ENTITIES), ("topics", MOST_TOPICS)):
        out = out.join(firsts(field, limit), key, "left").withColumn(field, F.coalesce(field, F.array().cast("array<string>")))
    return out


def correct(tagged: DataFrame, corrections: DataFrame, key: str = "id") -> DataFrame:
    """``tagged`` with a user's category in place of the rule's where ``corrections`` (key, category) has one. Such tags
    have source ``user`` and confidence 1. The last correction by ``at`` counts."""
    last = corrections.groupBy(key).agg(F.max_by("category", "at").alias("new"))
    given = F.col("new").isNotNull()
    tag = F.col("tag").withField("source", F.when(given, "user").otherwise(F.col("tag.source"))).withField("confidence", F.when(given, 1.0).otherwise(F.col("tag.confidence")))
    tag = tag.withField("category", F.coalesce("new", "tag.category"))
    return tagged.join(last, key, "left").withColumn("old_category", F.col("tag.category")).withColumn("corrected", given).withColumn("tag", tag).drop("new")


def correction_patterns(corrected: DataFrame, most: int = 10) -> DataFrame:
    """The most frequent changes, as old->new."""
    change = F.concat("old_category", F.lit("->"), F.col("tag.category"))
    return corrected.where("corrected").groupBy(change.alias("pattern")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pattern").limit(most)


def first_json(x) -> Column:
    """The first whole JSON object of a text: that of a fenced block, else the first balanced one that parses. Braces inside
    of strings don't count."""

    @F.arrow_udf("string")
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([_first_json(t) for at in range(0, len(texts), _AT_ONCE) for t in texts.slice(at, _AT_ONCE).to_pylist()], pa.string())

    return found(_c(x))


def _first_json(text: str | None) -> str | None:
    decoder = json.JSONDecoder()
    fenced = re.search(r"```(?:json)?\s*(\{.*?\})\s*```", text or "", re.S)
    for body in ([fenced.group(1)] if fenced else []) + [text or ""]:
        at = body.find("{")
        while at >= 0:
            try:
                _, end = decoder.raw_decode(body, at)
                return body[at:end]
            except ValueError:
                at = body.find("{", at + 1)
    return None


def parse_model_tag(x) -> Column:
    """A tag from a model's answer that holds JSON, fenced or bare; missing fields have defaults, no JSON is null."""
    return let(first_json(x), _tag_of_json)


def tag(x, answer=None) -> Column:
    """A model's tag where its ``answer`` has one, else that of the rules; both for records and for what is compressed."""
    return rule_tag(x) if answer is None else F.coalesce(parse_model_tag(answer), rule_tag(x))


def _tag_of_json(body: Column) -> Column:
    parsed = F.from_json(body, "category string, importance string, sentiment string, entities array<string>, time_sensitive boolean, topics array<string>")
    none = F.array().cast("array<string>")
    return F.when(
        body.isNotNull(),
        F.struct(
            F.coalesce(parsed["category"], F.lit("other")).alias("category"), F.coalesce(parsed["importance"], F.lit("medium")).alias("importance"),
            F.coalesce(parsed["sentiment"], F.lit("neutral")).alias("sentiment"), F.coalesce(parsed["entities"], none).alias("entities"),
            F.coalesce(parsed["time_sensitive"], F.lit(False)).alias("time_sensitive"), F.coalesce(parsed["topics"], none).alias("topics"),
            F.lit("llm").alias("source"), F.lit(0.9).alias("confidence"),
        ),
    )
