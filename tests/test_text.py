"""Text functions against plain Python on small inputs."""

import random
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from larkspur.functions import filters, tagging
from larkspur.functions import text as tx
from larkspur.functions import time as tm
from larkspur.operators import lifecycle, merging
from larkspur.schema import CONFIG

TEXTS = ["", " ", "hello world", "明天去北京开会，预算100万元", "OK", "😀😀", "aaaaaaa", "Version 2.0 of API接口 at 2024-05-01", "x" * 300, "a。b！c？\n d", "日本語\ttext %_", None]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")


def column(df, c):
    return [r[0] for r in df.select(F.col("id"), c.alias("v")).orderBy("id").select("v").collect()]


def py_tokens(t):
    t = t or ""
    cjk = sum("一" <= c <= "鿿" for c in t)
    ascii_ = sum(ord(c) < 128 for c in t)
    return int(cjk * 1.2 + ascii_ * 0.3 + (len(t) - cjk - ascii_) * 0.5)


def test_tokens(texts):
    assert column(texts, tx.tokens("text")) == [py_tokens(t) for t in TEXTS]


def test_hashes(texts):
    assert column(texts, tx.text_hash("text"))[2] == hashlib.sha256(b"hello world").hexdigest()[:32]
    assert column(texts, tx.content_hash("text"))[2] == hashlib.md5(b"hello world").hexdigest()[:16]
    assert column(texts, tx.vector_content_hash(F.concat(F.lit(" 　"), F.upper("text"))))[2] == hashlib.sha256(b"hello world").hexdigest()[:16]


def test_repetitive(texts):
    want = [len(t or "") >= 5 and max((t or "").count(c) for c in t) / len(t) > 0.7 for t in TEXTS]
    assert column(texts, tx.repetitive("text")) == want


def test_phrase_query(texts):
    got = column(texts, tx.phrase_query(F.concat("text", F.lit(' NOT "q"'))))
    assert got[2] == '"hello world ""q"""'
    assert column(texts, tx.phrase_query("text"))[:2] == ['""', '""']
    assert column(texts, tx.phrase_query(F.lit("and OR near")))[0] == '""'


def test_truncation(texts):
    got = column(texts, tx.truncate_tokens("text", 20))
    assert got[2] == "hello world" and got[8].endswith("...") and len(got[8]) < 80
    assert column(texts, tx.smart_truncate("text", 30))[2] == "hello world..."
    assert column(texts, tx.smart_truncate("text", 100))[7] == "Version 2.0 of API接口 at 2024-0 | 关键信息: 2.0, 2024, 05, 2024-05-01..."


def test_noise(spark):
    turns = [("嗯", "", "template", "discard"), ("", "", "rule", "discard"), ("好的知道了吧", "收到", "rule", "sqlite_only"), ("😀😀😀", "", "rule", "sqlite_only"), ("12345 !!", "", "rule", "sqlite_only"), ("不对，应该是200元", "好", "protected", "full"), ("tell me about spark", "it is an engine", "passed", "full"), ("哈哈哈哈哈哈", "", "rule", "sqlite_only"), (None, None, "rule", "discard")]
    df = spark.createDataFrame([(i, u, a) for i, (u, a, _, _) in enumerate(turns)], "id long, u string, a string")
    got = df.select("id", filters.noise(F.col("u"), F.col("a")).alias("n")).orderBy("id").collect()
    assert [(r.n.reason, r.n.storage) for r in got] == [(reason, storage) for _, _, reason, storage in turns]


def test_cjk_is_no_emoji(texts):
    assert column(texts, filters.pure_emoji("text")) == [t == "😀😀" for t in TEXTS]


def test_mask(spark):
    cases = {
        "call 13812345678 now": "call 138****5678 now",
        "密码：abc123!x done": "密码：**** done",
        "password:hunter22": "password:****",
        "a.b@c.de": "***@***.***",
        "ip 10.20.30.40": "ip 10.***.***.40",
        "sk-abcdefghijklmnopqrstuvwx": "****",
        "nothing": "nothing",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "id long, text string")
    masked = column(df, filters.mask("text"))
    assert masked == list(cases.values())
    again = spark.createDataFrame(list(enumerate(masked)), "id long, text string")
    assert column(again, filters.mask("text")) == masked
    assert column(df, filters.mask("text", excluded=["call"]))[0] == "call 13812345678 now"
    off = filters.configure(enable={"phone": False}, custom=[filters.Rule("word", "now", "N")])
    assert column(df, filters.mask("text", off))[0] == "call 13812345678 N"
    assert column(df, filters.mask(F.lit(None).cast("string")))[0] is None


def test_tags(spark):
    df = spark.createDataFrame([(0, "明天有紧急会议，讨论项目报告"), (1, "Nice movie, love the music"), (2, ""), (3, None)], "id long, text string")
    t = [r.t for r in df.select("id", tagging.rule_tag("text").alias("t")).orderBy("id").collect()]
    assert (t[0].category, t[0].importance, t[0].time_sensitive) == ("work", "high", True)
    assert (t[1].category, t[1].sentiment) == ("entertainment", "positive")
    assert t[2].category == t[3].category == "other" and abs(t[2].confidence - 0.5) < 1e-9


def test_model_tag(spark):
    df = spark.createDataFrame([(0, 'so ```json\n{"category": "tech", "topics": ["a"]}\n```'), (1, "none")], "id long, text string")
    got = column(df, tagging.parse_model_tag("text"))
    assert got[0].category == "tech" and got[0].importance == "medium" and got[0].topics == ["a"] and got[1] is None


def test_time_context(spark):
    df = spark.createDataFrame([(0, "what did I say yesterday"), (1, "上周的会议"), (2, "none")], "id long, text string")
    assert [r.type for r in column(df, tm.time_context(F.col("text")))] == ["yesterday", "last_week", "any"]


def test_decay_edges(spark):
    hours = [0.0, 0.99, 1.0, 5.99, 6.0, 24.0, 167.0, 168.0, None]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hours)], "id long, h double")
    now = F.lit("2024-07-01 00:00:00").cast("timestamp_ntz")
    then = now - F.make_dt_interval(secs=(F.col("h") * 3600).cast("decimal(18,6)"))
    assert column(df, tm.time_decay(then, now)) == [1.0, 1.0, 0.8, 0.8, 0.6, 0.4, 0.4, 0.2, 0.5]


def test_parse_time(spark):
    df = spark.createDataFrame([(0, "2024-05-01T10:20:30.123456"), (1, "2024-05-01 10:20:30"), (2, "2024-05-01"), (3, "x")], "id long, text string")
    assert [None if v is None else v.day for v in column(df, tm.parse_time(F.col("text")))] == [1, 1, 1, None]


def test_rule_compress(spark):
    text = "这是开头。" * 10 + "重要的结论在这里。" + "其他内容。" * 10 + "重要的结论在这里。"
    df = spark.createDataFrame([(0, text), (1, "短"), (2, "x" * 3000)], "id long, text string")
    assert column(df, lifecycle.rule_compress("text")) == ["重要的结论在这里。", None, "x" * CONFIG.compress_max_segment + "..."]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0, *(max(row[j + 1], p) if x != b[j] else row[j] + 1 for j, p in enumerate(_running(row, x, b)))]
    return row[-1]


def _running(row, x, b):
    """The value to the left in the row being made."""
    left = 0
    for j, y in enumerate(b):
        yield left
        left = row[j] + 1 if x == y else max(row[j + 1], left)


def test_common_words_are_a_longest_subsequence():
    r = random.Random(4)
    for _ in range(300):
        a, b = ([r.choice("abcde") for _ in range(r.randint(0, 12))] for _ in range(2))
        both = [w for w, k in zip(b, merging.common_words(a, b)) if k]
        rest = iter(a)
        assert all(w in rest for w in both) and len(both) == lcs(a, b)
    assert sum(merging.common_words(["x"] * 200, ["x", "y"] * 50_000)) == 200


def test_merge_texts():
    base = "the cat sat on the mat"
    assert merging.additions(base, "the big cat sat on a  red mat today") == ["big", "a  red", "today"]
    assert merging.additions("今天很好", "今天天气很好吗") == ["天气", "吗"] or merging.additions("今天很好", "今天天气很好吗") == ["天", "气", "吗"]
    assert merging.merge_texts([base, "the big cat", "a BIG cat sat", base]) == f"{base} | big | a BIG"
    assert merging.merge_texts(["a" * 600, "b"]) == "a" * 497 + "..." and merging.merge_texts([]) == ""
    assert merging.merge_texts(["", None, "new words"]) == " | new words"



def test_entities(spark):
    df = spark.createDataFrame([(0, "Alice Smith paid 30元 to NASA 订单系统")], "id long, text string")
    assert set(column(df, tx.entities("text"))[0]) >= {"Alice Smith", "NASA", "30元"}
    assert re.match("订单", column(df, tx.entities("text"))[0][-1])
