"""Queries of this subpackage and, where SQL can express one, the SQL."""

from . import chat, language, neardup, onebit, packing, pieces, pii, substrings, topk, urls

QUERIES = {
    "op1_pii_surrogates": pii.op1_pii_surrogates,
    "op2_near_duplicates": neardup.op2_near_duplicates,
    "op3_language_id": language.op3_language_id,
    "op4_sentencepiece": pieces.op4_sentencepiece,
    "op5_exact_topk": topk.op5_exact_topk,
    "op6_chat_format": chat.op6_chat_format,
    "op7_packing": packing.op7_packing,
    "op8_url_filter": urls.op8_url_filter,
    "op9_one_bit_ann": onebit.op9_one_bit_ann,
    "op10_substring_dedup": substrings.op10_substring_dedup,
}
ORACLE_SQL = {
    "op2_near_duplicates": neardup.OP2_SQL,
    "op5_exact_topk": topk.OP5_SQL,
    "op6_chat_format": chat.OP6_SQL,
    "op8_url_filter": urls.OP8_SQL,
    "op10_substring_dedup": substrings.OP10_SQL,
}
