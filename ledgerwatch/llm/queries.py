"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import bpe, chat, filters, infill, language, licences, lines, media, mixing, ngrams, pii, suffixes, vectors

QUERIES = {
    "op1_vector_dedup": vectors.op1_vector_dedup,
    "op2_mixing": mixing.op2_mixing,
    "op3_pii": pii.op3_pii,
    "op4_avi_mjpeg": media.op4_avi_mjpeg,
    "op5_chat": chat.op5_chat,
    "op6_licences": licences.op6_licences,
    "op7_bpe": bpe.op7_bpe,
    "op8_line_dedup": lines.op8_line_dedup,
    "op9_language": language.op9_language,
    "op10_ngram_join": ngrams.op10_ngram_join,
    "op11_filter_audit": filters.op11_filter_audit,
    "op12_suffix_dedup": suffixes.op12_suffix_dedup,
    "op13_infill": infill.op13_infill,
}

ORACLES = {
    "op1_vector_dedup": vectors.ORACLE,
    "op5_chat": chat.ORACLE,
    "op6_licences": licences.ORACLE,
    "op8_line_dedup": lines.ORACLE,
    "op10_ngram_join": ngrams.ORACLE,
    "op11_filter_audit": filters.ORACLE,
    "op12_suffix_dedup": suffixes.ORACLE,
    "op13_infill": infill.ORACLE,
}
