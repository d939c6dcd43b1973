"""The queries of this subpackage, and the SQL of those that SQL can express."""

from . import bpe, langid, mih, mixing, omh, pii, polytope, quality, spans, sufdedup

QUERIES = {
    "op1_omh": omh.query,
    "op2_sentence_spans": spans.query,
    "op3_multi_index_hashing": mih.query,
    "op4_suffix_array": sufdedup.query,
    "op5_language_id": langid.query,
    "op6_mixing": mixing.query,
    "op7_bpe": bpe.query,
    "op8_quality": quality.query,
    "op9_pii": pii.query,
    "op10_cross_polytope": polytope.query,
}
ORACLES: dict[str, str] = {"op2_sentence_spans": spans.ORACLE, "op3_multi_index_hashing": mih.ORACLE, "op4_suffix_array": sufdedup.ORACLE, "op10_cross_polytope": polytope.ORACLE}
