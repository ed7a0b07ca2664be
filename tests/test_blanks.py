"""White space as the web defines it, by pattern and by trimming."""

import time

from pyspark.sql import functions as F

from quire.functions import text as fx

WHITE = [0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]


def test_every_character_is_white_or_not(spark):
    codes = [i for i in range(1, 0x11000) if not 0xD800 <= i < 0xE000]
    rows = spark.createDataFrame([(i, chr(i)) for i in codes], "i int, c string")
    c = F.col("c")
    seen = rows.select("i", c.rlike(rf"^[{fx.WS}]\z").alias("a"), c.rlike(rf"^[^{fx.WS}]\z").alias("b"), (fx.js_trim(c) == "").alias("t"), c.rlike(rf"^[^{fx.WS})>\]]\z").alias("u")).collect()
    for r in seen:
        white = r.i in WHITE
        assert (r.a, r.b, r.t, r.u) == (white, not white, white, not white and chr(r.i) not in ")>]"), r.i


def test_trimming_takes_time_for_the_ends_only(spark):
    inside = "a b　c"
    rows = spark.createDataFrame([("﻿ \t" + inside + " \n",), ("",), (" ",), (None,)], "c string")
    assert [r[0] for r in rows.select(fx.js_trim(F.col("c"))).collect()] == [inside, "", "", None]
    long = spark.range(0, 40, 1, 1).select(F.repeat(F.concat(F.lit("word "), F.col("id").cast("string")), 100_000).alias("c")).cache()
    long.count()
    began = time.time()
    long.select(F.sum(F.length(fx.js_trim(F.col("c"))))).collect()
    plain = time.time() - began
    began = time.time()
    long.select(F.sum(F.length(F.regexp_replace("c", r"^[\t-\r    -     　﻿]+|[\t-\r    -     　﻿]+\z", "")))).collect()
    assert plain < (time.time() - began) / 2
