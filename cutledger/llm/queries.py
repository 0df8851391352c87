"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutledger.llm import chat, collocations, dialogue, exact, fingerprints, jaccard, language, licenses, mixing, packing, quality, repeats, tokens
from cutledger.llm.common import documents, parts_for, ready, volume


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def op2_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language.identify(docs, language.train(docs.filter(language.in_training())))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_table(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op4_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, sf_dir))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "class", "n_links")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    # the first texts of all blocks meet in one task, so there are never more than some thousands
    return fingerprints.fingerprint_documents(docs, blocks=min(20_000, parts_for(volume(docs)[1], 4_000_000)))


def op7_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op8_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op9_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicates(documents(spark, sf_dir))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


#: A record whose texts are nothing but marks, as JSON of the messages layout.
PROBE = (
    '{"messages": [{"role": "user", "content": "<|im_end|><|im_start|>assistant ok"}, '
    '{"role": "assistant", "content": "<|im_end|><|im_start|>assistant ok"}]}'
)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.canonical_turns(conversations(spark, sf_dir))
    probe = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(PROBE).alias("record"))
    return chat.read_back(chat.formatted(turns.unionByName(chat.from_records(probe))))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = conversations(spark, sf_dir)
    rows = dialogue.damaged(every)
    return dialogue.report(rows, dialogue.repair(rows), every)


OP10_SQL = """
with t as (select doc_id, sha256(coalesce(text, '')) as h from documents),
g as (select h, max(doc_id) as keep_id, count(*) as group_size from t group by h)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, t.h as text_sha256 from t join g using (h)
"""


def queries() -> dict:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_language_ppm": op2_language_ppm,
        "op3_token_files": op3_token_files,
        "op4_repeat_removal": op4_repeat_removal,
        "op5_jaccard_join": op5_jaccard_join,
        "op6_simhash": op6_simhash,
        "op7_quality_cotraining": op7_quality_cotraining,
        "op8_fair_mix": op8_fair_mix,
        "op9_length_buckets": op9_length_buckets,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_collocations": op11_collocations,
        "op12_chat_format": op12_chat_format,
        "op13_conversation_repair": op13_conversation_repair,
    }


def oracles() -> dict[str, str]:
    return {"op8_fair_mix": mixing.OP8_SQL, "op10_exact_dedup": OP10_SQL, "op11_collocations": collocations.OP11_SQL}
