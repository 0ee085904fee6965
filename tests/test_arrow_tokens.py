"""Tokens by numpy over bytes against the expression."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from korpusflow.functions import arrow
from korpusflow.functions.text import tokens

ODD = ["", None, " ", "a", "-", "́", "á ́ b", "ЁЖ Ёж ёАЯп", "×a÷b", "ÀÖØÞ", "\x80\xbf\xc0", " ‿⁀⁰ⁱx⿿y", "😀a😀 b", "中文 、字", "A-Z_0/9:@[`{\x7f~"]


def test_equal_to_the_expression(spark):
    r = random.Random(3)
    alphabet = "aZ-/,. \n\x00\x7f" + "́ёЁАЯРПрпя" + "\x80\xa0\xbf\xd7\xf7\xc0\xff" + "῿ ‿⁀⁰ⁱ⿿" + "😀中"
    texts = ODD + ["".join(r.choices(alphabet, k=r.randrange(40))) for _ in range(1500)] + [None, "end"]
    want = [x.w for x in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").coalesce(1).select("i", tokens(F.col("t")).alias("w")).orderBy("i").collect()]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["t"])
    got = []
    for piece in arrow.pieces(iter([batch.slice(3), batch.slice(0, 3)]), 0, 100):
        flat, sizes = arrow.token_array(piece.column(0))
        own = iter(flat.to_pylist())
        got += [[next(own) for _ in range(n)] for n in sizes]
    assert got == want[3:] + want[:3]
