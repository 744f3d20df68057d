"""The thin queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.llm import alignment, extraction, languages, licenses, media, mixing, negatives, pieces, pii, quality, simhash, topk, urls
from eventloom.llm.common import table


def op1_pieces(spark, sf_dir):
    """The ids of every document, and whether decoding gives its text back."""
    model = pieces.Pieces()
    found = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), model), model)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", (F.xxhash64("text") == F.col("text_key")).alias("round_trip"))


def op2_mixing(spark, sf_dir):
    """How many words the mix takes from each document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_pii(spark, sf_dir):
    """Personal data in every document, by pattern and by what its neighbours reveal."""
    return pii.described(pii.sensitive(table(spark, sf_dir, "documents")))


def op4_media(spark, sf_dir):
    """Every text stored as NPY tiles, read back and described."""
    return media.described(media.text_media(table(spark, sf_dir, "documents")))


def op5_licenses(spark, sf_dir):
    """Every document's license, its own or that of a license file in its source; a document is a file of its source's directory."""
    place = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    files = table(spark, sf_dir, "documents").select("doc_id", place.alias("path"), "text")
    return licenses.scan(files, licenses.template_table(spark))


def op6_quality(spark, sf_dir):
    """The quality of every document, learned from the rows that are not held out."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_languages(spark, sf_dir):
    """Every page's language; 3-grams are learned from the documents' labels."""
    return languages.identify(table(spark, sf_dir, "pages"), languages.fit(table(spark, sf_dir, "documents")))


def op8_simhash(spark, sf_dir):
    """Fingerprints and near-duplicate components of all documents."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_urls(spark, sf_dir):
    """Every page's url judged by the fixed rules."""
    return urls.judge(table(spark, sf_dir, "pages"), urls.rule_table(spark))


def op10_topk(spark, sf_dir):
    """The five best rows for every 50th vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op11_extraction(spark, sf_dir):
    """The main text of every page."""
    return extraction.extract(table(spark, sf_dir, "pages"))


def op12_negatives(spark, sf_dir):
    """Hard negatives of every 100th vector, between three and nine tenths of each of its positives' scores."""
    return negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_align(spark, sf_dir):
    """Every document by two tokenizers, aligned, with counts of linked ids over all documents."""
    return alignment.align(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_pieces": op1_pieces,
    "op2_mixing": op2_mixing,
    "op3_pii": op3_pii,
    "op4_media": op4_media,
    "op5_licenses": op5_licenses,
    "op6_quality": op6_quality,
    "op7_languages": op7_languages,
    "op8_simhash": op8_simhash,
    "op9_urls": op9_urls,
    "op10_topk": op10_topk,
    "op11_extraction": op11_extraction,
    "op12_negatives": op12_negatives,
    "op13_align": op13_align,
}
ORACLES = {
    "op2_mixing": mixing.ORACLE,
    "op5_licenses": licenses.oracle("select doc_id, coalesce(source, '-') || '/' || coalesce(doc_id::varchar, '-') as path, text from documents"),
    "op9_urls": urls.ORACLE,
    "op10_topk": topk.ORACLE,
    "op12_negatives": negatives.ORACLE,
}
