"""The subpackage's queries and the SQL of those that SQL can express."""

from . import bpe, contamination, langid, layout, lm, media, mixing, pii, runs, simhash, toxicity, vectors, warc

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_langid": langid.op2_langid,
    "op3_vectors": vectors.op3_vectors,
    "op4_media": media.op4_media,
    "op5_bpe": bpe.op5_bpe,
    "op6_lm": lm.op6_lm,
    "op7_simhash": simhash.op7_simhash,
    "op8_warc": warc.op8_warc,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_mix": mixing.op10_mix,
    "op11_runs": runs.op11_runs,
    "op12_layout": layout.op12_layout,
    "op13_decontaminate": contamination.op13_decontaminate,
}
SQL = {"op3_vectors": vectors.SQL, "op8_warc": warc.SQL, "op10_mix": mixing.SQL, "op12_layout": layout.SQL, "op13_decontaminate": contamination.SQL}
