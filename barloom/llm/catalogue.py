"""Queries of this package: name -> (Spark callable, SQL for the same rows or None)."""

from barloom.llm import (
    chat, html, jaccard, langid, lines, mixing, phrases, repair, repeats, tiling, tokens, urls, vectors,
)

QUERIES = {
    "op1_vectors": (vectors.op1_vectors, vectors.SQL_VECTORS),
    "op2_decontamination": (tiling.op2_decontamination, None),
    "op3_tokens": (tokens.op3_tokens, None),
    "op4_chat": (chat.op4_chat, chat.SQL_CHAT),
    "op5_urls": (urls.op5_urls, None),
    "op6_lines": (lines.op6_lines, None),
    "op7_langid": (langid.op7_langid, None),
    "op8_html": (html.op8_html, None),
    "op9_jaccard": (jaccard.op9_jaccard, jaccard.SQL_JACCARD),
    "op10_mixing": (mixing.op10_mixing, mixing.SQL_MIX),
    "op11_repeats": (repeats.op11_repeats, repeats.SQL_REPEATS),
    "op12_phrases": (phrases.op12_phrases, phrases.SQL_PHRASES),
    "op13_repair": (repair.op13_repair, repair.SQL_REPAIR),
}
