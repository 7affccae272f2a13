import pytest

from threatlake.llm.common import table

EXTRA = "shard int, slot int, h string, maybe string, row string, n string, token string, bucket string, text_sha256 string, keep_id string, query boolean, _id string, root string, url string"


@pytest.fixture(scope="session")
def odd_rows(spark, sf_dir):
    """(doc_id, text, source): real documents, then nulls, empty and long texts, ties and repeated rows."""
    real = [(r.doc_id, r.text, r.source) for r in table(spark, sf_dir, "documents").orderBy("doc_id").limit(60).collect()]
    words = [f"w{k % 977}x{k % 31}" for k in range(60_000)]
    near = [f"n{k}" for k in range(80)]
    return [
        *real, (1000, None, None), (1001, "", "src1"), (1002, " \t\n\r\x0b\x0c", None), (1003, "one", "src0"), (1004, "One", "src0"), (1005, "a b c d", ""), (1006, "a b\nc  D", "src2"),
        (1007, " ".join(words), "src0"), (1008, " ".join([*words[:-3], "x", "y", "z"]), "src0"), (1009, " ".join(near), "src3"), (1010, " ".join([*near, "more"]), "src3"),
        (1011, " ".join([*near[:40], "mid", *near[40:]]), "src3"), (1012, " ".join(near[:62]), "src3"), (1013, "\n".join(["same line"] * 5 + ["own 13"]), "src4"),
        *[(1020 + k, f"same line\n  SAME LINE \nown {k}\n\n", "src5") for k in range(12)], (1040, "repeat me", "src6"), (1040, "repeat me", "src6"), (1041, "repeatme ", "src6"),
        (1042, "<|endoftext|> it's <|startoftext|>DON'T é́ ΟΔΟΣ İ ½ 12 ''s 'll", "src7"), (1043, "中文 字符😀　x y \x1c z", "src7"), (1044, "a" * 3000 + " " + "!" * 500, "src8"),
        (None, "no id", "src9"), (None, None, None), (-5, "negative id", "src9"),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    names = [c.split(" ")[0] for c in EXTRA.split(", ")]
    filled = [(i, t, "en", s, None, *([None] * len(names))) for i, t, s in odd_rows]
    return spark.createDataFrame(filled, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {EXTRA}").repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("doc_id = 123456")
