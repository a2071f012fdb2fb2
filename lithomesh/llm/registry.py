"""Queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

from lithomesh.llm import bpe, chat_format, content_sort, html_text, jaccard_join, packing, pivot_index, quality, secrets, warc

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_html_text": html_text.op2_html_text,
    "op3_content_sort": content_sort.op3_content_sort,
    "op4_packing": packing.op4_packing,
    "op5_warc": warc.op5_warc,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_bpe": bpe.op7_bpe,
    "op8_jaccard": jaccard_join.op8_jaccard,
    "op9_pivot_index": pivot_index.op9_pivot_index,
    "op10_secrets": secrets.op10_secrets,
}

SQL = {
    "op3_content_sort": content_sort.OP3_SQL,
    "op5_warc": warc.OP5_SQL,
    "op6_chat_format": chat_format.OP6_SQL,
    "op8_jaccard": jaccard_join.OP8_SQL,
    "op9_pivot_index": pivot_index.OP9_SQL,
}
