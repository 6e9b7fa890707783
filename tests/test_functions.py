import math

from pyspark.sql import functions as F

from graphloom.functions import hashing, text, vectors
from graphloom.operators.questions import parse, recognised


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first().y


def test_normalisation(spark):
    assert one(spark, "  Deep–Fried \t Tofu‑Skin ", text.key) == "deep fried tofu skin"
    assert one(spark, "ＦＵＬＬ　Width", text.name) == "full width"
    assert one(spark, "Straße & Co.", text.term) == "strasse co"
    assert one(spark, None, text.name) is None


def test_tokens(spark):
    assert one(spark, "Don't over-cook 豆腐 2x Ñandú", text.tokens) == ["don't", "over-cook", "豆", "腐", "2x", "ñandú"]
    assert one(spark, "ＦＵＬＬ ﬁne e\u0301t\u00e9 ①", text.tokens) == ["full", "fine", "été", "1"]
    assert one(spark, None, text.tokens) is None


def test_lines(spark):
    assert one(spark, " a \r\n\n　b\n  ", text.lines) == ["a", "b"]


def test_numbers(spark):
    assert one(spark, "bake 2 or 2.50 of 1/2 at 007, twice 2", text.numbers) == ["2", "2.5", "1/2", "7"]
    for refused in ("1e3", "1,000", "1_000", "take .5"):
        assert one(spark, refused, text.numbers) is None
    assert one(spark, "none", text.numbers) == []
    assert one(spark, "1. add three eggs, 十五克, -5", text.numbers) == ["-5", "3", "15"]
    assert one(spark, "第三步：加半杯水, half of it, Twenty", text.numbers) == ["0.5", "20"]
    assert one(spark, "+10.0 and 3.0/04 x2", text.numbers) == ["10", "3/4"]


def test_chinese_numbers(spark):
    want = {"十": 10, "十五": 15, "二十": 20, "三百零五": 305, "两千": 2000, "半": 0.5, "45": 45, "七": 7, "x": None, "三万五千": 35000, "一万": 10000, "万": 10000, "二十万零三": 200003, "三五": 35, "一个半": None}
    assert {k: one(spark, k, text.chinese_number) for k in want} == want


def test_limits(spark):
    assert one(spark, "within 2 hours or 45 minutes", text.minutes_limit) == 45
    assert one(spark, "半小时以内", text.minutes_limit) == 30
    assert one(spark, "soon", text.minutes_limit) is None


def test_alias_boundaries(spark):
    assert one(spark, "an egg", lambda c: text.contains_alias(c, "egg")) and not one(spark, "eggplant", lambda c: text.contains_alias(c, "egg"))
    assert one(spark, "炒豆腐干", lambda c: text.contains_alias(c, "豆腐"))


def test_urls(spark):
    want = {"https://a.b/c": True, "ftp://a.b": False, "https://u:p@a.b": False, "https://a b": False, None: False, "http://": False}
    assert {k: one(spark, k, text.url_valid) for k in want} == want


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), ([float("nan"), 1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    rows = df.select(vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.valid(F.col("a"), 2, 4.9, 5.1).alias("v")).collect()
    assert math.isclose(rows[0].c, 0.96) and rows[1].c is None and [r.v for r in rows] == [True, False, False]
    mean = vectors.mean_unit(spark.createDataFrame([("g", [1.0, 0.0]), ("g", [0.0, 1.0])], "g string, v array<double>"), "g", "v").collect()
    assert all(math.isclose(r.x, math.sqrt(0.5)) for r in mean)


def test_hashes(spark):
    assert one(spark, "abc", lambda c: hashing.uid("k", c, 20)) == "k:ba7816bf8f01cfea4141"
    assert one(spark, "123456789", hashing.crc_hex) == "cbf43926"
    df = spark.createDataFrame([(1, "a"), (2, None)], "i long, s string")
    assert hashing.content_hash(df, ["i", "s"]).first() == hashing.content_hash(df.orderBy(F.desc("i")), ["i", "s"]).first()
    hashed = lambda *row: hashing.content_hash(spark.createDataFrame([row], "a string, b string"), ["a", "b"]).first().content_hash
    assert len({hashed("a|b", "c"), hashed("a", "b|c"), hashed(None, ""), hashed("", None), hashed("-", ""), hashed("1:a", "")}) == 6


def test_questions():
    aliases = {"egg": "egg", "eggs": "egg", "egg noodle": "noodle", "豆腐": "tofu", "onion": "onion"}
    assert [x[2] for x in recognised("egg noodle with 豆腐 and Eggs", aliases)] == ["noodle", "tofu", "egg"]
    c = parse("eggs and 豆腐, without onion, in 30 minutes or half an hour, quick", aliases, ("quick", "spicy"))
    assert (c.available, c.excluded, c.at_most, c.required_tags) == (("egg", "tofu"), ("onion",), 30.0, ("quick",))
    d = c.tightened(parse("no egg, 1 hour", aliases))
    assert d.excluded == ("onion", "egg") and d.at_most == 30.0


def test_question_plans(spark):
    from graphloom.operators.questions import numeral, plan, planned

    aliases = {"番茄": "番茄", "西红柿": "番茄", "鸡蛋": "鸡蛋", "辣椒": "辣椒", "盐": "盐", "egg": "egg", "eggs": "egg", "tomato": "tomato", "salt": "salt"}
    tags = {"不辣": ["不辣", "不吃辣"], "素食": ["素食", "吃素"]}
    get = lambda text: plan(text, aliases, tags)
    for text, available, excluded, unavailable in (
        ("我有番茄和鸡蛋，不吃鸡蛋", ["番茄", "鸡蛋"], ["鸡蛋"], []), ("我有番茄，不吃鸡蛋和辣椒", ["番茄"], ["鸡蛋", "辣椒"], []), ("我只有番茄，没有鸡蛋", ["番茄"], [], ["鸡蛋"]),
        ("我有番茄，鸡蛋还没买", ["番茄"], [], ["鸡蛋"]), ("我有番茄，想用鸡蛋做菜", ["番茄"], [], []), ("我有西红柿和鸡蛋，但不能吃鸡蛋", ["番茄", "鸡蛋"], ["鸡蛋"], []), ("番茄炒鸡蛋怎么做", ["番茄", "鸡蛋"], [], []),
        ("有番茄和鸡蛋，十分钟以内做菜", ["番茄", "鸡蛋"], [], []), ("没有主料，推荐番茄", ["番茄"], [], []), ("I have eggs and salt, without tomato", ["egg", "salt"], ["tomato"], []), ("I'm out of eggs; tomato please", ["tomato"], [], ["egg"]), ("", [], [], []),
    ):
        found = get(text)
        assert (found["available"], found["excluded"], found["unavailable"]) == (available, excluded, unavailable), text
    found = get("我有番茄和鸡蛋，二十分钟内，1小时，不吃辣，不放盐")
    assert (found["at_most"], found["tags"], found["excluded"], found["allow_missing"]) == (20.0, ["不辣"], ["盐"], False)
    assert get("我有番茄和蘑菇")["unknown"] == ["蘑菇"] and get("半小时")["at_most"] == 30.0 and get("99999 分钟")["at_most"] is None
    assert get('find "pan fried" eggs, not salt')["lexical_query"] == "pan fried find pan fried eggs egg" and get("可以补买吗")["allow_missing"]
    assert [numeral(x) for x in ("三十五", "十", "一百零五", "12", "两")] == [35, 10, 105, 12, 2]
    rows = planned(spark.createDataFrame([(1, "I have eggs"), (2, None)], "i long, q string"), "q", aliases).collect()
    assert rows[0].plan.available == ["egg"] and rows[1].plan is None
