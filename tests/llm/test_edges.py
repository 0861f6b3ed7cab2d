"""Of all operators on documents and the pipeline's stages: columns with clashing names, nulls, very long texts, repeated rows."""

import random

import public_tokenizers
import pytest

import corpus_pipeline
from spanloom.llm import chat, decontam, fim, langid, license, packing, pii, quality, simhash, suffix_dedup, toxicity

DIR = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
#: Names that the operators make for themselves.
CLASHING = "tie h c d u v fp root r m p kind lead blob runs spans start stop row g crcs ids stratum kept rule good bad toxic word a b w item_id i t n k x base terms entities entity context doc score held_out lang_pred bound at sets op seq msg_id last first named parts band cell hashes salt least label quality __row __w __s __at __id __tie __terms __found __simhash_r __simhash_row __simhash_id __simhash_h __stratum _c0 value count fim form output n_words n_hit".split()

OPS = {
    "op1": lambda d, b, m: license.op1(d),
    "op2": lambda d, b, m: quality.op2(d, m),
    "op4": lambda d, b, m: toxicity.op4(d, m),
    "op5": lambda d, b, m: packing.op5(d, PATH).select("doc_id", "start", "length", "ids_crc32", "doc_tokens"),
    "op6": lambda d, b, m: decontam.op6(d, b),
    "op7": lambda d, b, m: simhash.op7(d),
    "op8": lambda d, b, m: pii.op8(d),
    "op9": lambda d, b, m: langid.op9(d),
    "op10": lambda d, b, m: suffix_dedup.op10(d),
    "op12": lambda d, b, m: fim.op12(d),
}
STAGES = {
    "quality_rules": lambda d, b, m: quality.keep_good(d, m),
    "simhash_near_dedup": lambda d, b, m: simhash.keep_one(d),
    "decontamination": lambda d, b, m: decontam.remove(d, b),
    "personal_data": lambda d, b, m: pii.sanitise(d),
}


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(3)
    rows = [tuple(x) for x in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(60).collect()]
    long = " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(200_000))
    rows += [(None, None, None, None, None), (None, rows[0][1], "en", None, 5), (1000, "", "en", "web", 0), (1001, long, "en", "web", len(long)), (1002, "x" * 300_000, None, "web", 300_000), rows[3], rows[3], (rows[4][0], rows[5][1], "de", "web", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/edges")
    return spark.read.parquet(path), spark.read.parquet(f"{DIR}/benchmark.parquet"), spark.read.parquet(f"{DIR}/labels.parquet"), len(rows)


def more(docs):
    from pyspark.sql import functions as F

    return docs.select("*", *(F.array(F.lit(k)).alias(c) if k % 5 == 0 else F.lit(c).alias(c) for k, c in enumerate(CLASHING)))


def ordered(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", list(OPS))
def test_operators(tables, name):
    docs, benchmark, labels, n = tables
    plain = ordered(OPS[name](docs, benchmark, labels))
    assert len(plain) == n if name != "op5" else len(plain) > n
    assert ordered(OPS[name](more(docs), benchmark, labels)) == plain


@pytest.mark.parametrize("name", list(STAGES))
def test_stages(tables, name):
    docs, benchmark, labels, _ = tables
    plain = STAGES[name](docs, benchmark, labels)
    wide = STAGES[name](more(docs), benchmark, labels)
    assert plain.columns == docs.columns and wide.columns == docs.columns + CLASHING
    assert ordered(wide.select(*docs.columns)) == ordered(plain)


def test_all_stages_are_here():
    assert [n for n, _ in corpus_pipeline.STAGES[:-1]] == list(STAGES)


def test_chat(spark):
    from pyspark.sql import functions as F

    rows = [(1, 0, "user", "a" * 400_000), (1, 1, "assistant", "b"), (None, None, None, None), (1, 1, "assistant", "b")]
    log = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    wide = log.select("*", *(F.lit(1).alias(c) for c in CLASHING))
    assert ordered(chat.op3(wide)) == ordered(chat.op3(log))
