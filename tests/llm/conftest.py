"""A small table of hard rows, with columns whose names the operators use themselves."""

import pytest

LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(30_000))
NEAR = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen " * 4
HARD_ROWS = [
    (1, None, "en", "src1"),
    (2, "", "en", None),
    (3, " \t\n\x0b\r ", None, "src1"),
    (4, "one", "en", "src2"),
    (5, "one two three four", "en", "src2"),
    (6, "ONE two  three four", "de", "src2"),
    (7, "A b C d e f g h", "en", "src3"),
    (8, "a B c d\ne f g h", "en", "src3"),
    (8, "a B c d\ne f g h", "en", "src3"),
    (9, LONG, "en", "src1"),
    (10, LONG, "en", "src1"),
    (11, LONG + " tail", "en", "src4"),
    (12, NEAR + "end", "en", "src4"),
    (13, NEAR + "other end", "en", "src4"),
    (14, "<|endoftext|> said I'm <|endoftext|>", "en", "src5"),
    (15, "漢字かな 😀😀 naïve   x\u00a0y \u2009z", "fr", "src5"),
    (16, "you are a worthless idiot, pathetic scum", "en", "src5"),
    (17, "abcdefgh" * 4000, "en", "src5"),
    (None, "a row without an id but with a few words", "en", "src6"),
    (None, None, None, None),
]
COLUMNS = "doc_id bigint, text string, lang string, source string"
CLASHING = (
    "kept boolean, keep_id string, node bigint, score string, shard int, fingerprint string, _number int, bucket int"
)


def _frame(spark, rows):
    df = spark.createDataFrame([(*r, *[None] * 8) for r in rows], f"{COLUMNS}, {CLASHING}")
    return df.repartition(3)


@pytest.fixture(scope="session")
def hard(spark):
    return _frame(spark, HARD_ROWS)


@pytest.fixture(scope="session")
def nothing(spark):
    return _frame(spark, [])


@pytest.fixture(scope="session")
def small(spark):
    from stratalog.llm.common import documents

    return documents(spark, "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
