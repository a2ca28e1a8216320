"""One registered query per operator, each over its whole table with production parameters."""

from . import (chat, digests, infill, langmodel, licences, packing, pieces, pii, quality, repeats,
               simhash, spelling, token_files)
from .common import table, vocabulary

QUERIES = {}
SQL = {}


def register(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


@register("op1_suffix_array_dedup")
def suffix_array_dedup(spark, sf):
    return repeats.remove_repeats(table(spark, sf, "documents"))


@register("op2_simhash_near_dedup")
def simhash_near_dedup(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents"))


@register("op3_document_fingerprints")
def document_fingerprints(spark, sf):
    return digests.fingerprints(table(spark, sf, "documents"))


@register("op4_chat_formatting", chat.SQL)
def chat_formatting(spark, sf):
    return chat.digests(chat.format_chat(chat.with_sample(table(spark, sf, "conversations"))))


@register("op5_quality_rules")
def quality_rules(spark, sf):
    docs = table(spark, sf, "documents")
    return quality.quality_rules(docs, bands=quality.fit_bands(docs, table(spark, sf, "labels")))


@register("op6_sentencepiece")
def sentencepiece(spark, sf):
    return pieces.hashed(pieces.encode(table(spark, sf, "documents"),
                                       vocabulary("piece_bpe_32k.model")))


@register("op7_license_scans", licences.SQL)
def license_scans(spark, sf):
    return licences.scan_licences(table(spark, sf, "documents"))


@register("op8_pii")
def personal_data(spark, sf):
    return pii.personal_data(table(spark, sf, "documents"))


@register("op9_lm_scoring")
def lm_scoring(spark, sf):
    return langmodel.lm_scores(table(spark, sf, "documents"))


@register("op10_packing")
def packed(spark, sf):
    return packing.pack(table(spark, sf, "documents"), vocabulary("word_bpe_49k.json"))


@register("op11_fill_in_middle", infill.SQL)
def fill_in_middle(spark, sf):
    return infill.digests(infill.fill_in_middle(table(spark, sf, "documents")))


@register("op12_spelling_variants")
def spelling_variants(spark, sf):
    return spelling.spelling_variants(table(spark, sf, "documents"))


@register("op13_token_files")
def id_files(spark, sf):
    return token_files.documents(token_files.write_files(
        table(spark, sf, "documents"), vocabulary("word_bpe_49k.json")))
