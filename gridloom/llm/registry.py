"""Queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from . import bpe, extraction, fingerprints, langid, licenses, minhash, mixing, neighbors, prefixes, resampling, secrets, toxicity, warc

QUERIES = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_warc": warc.op2_warc,
    "op3_bpe": bpe.op3_bpe,
    "op4_licenses": licenses.op4_licenses,
    "op5_langid": langid.op5_langid,
    "op6_secrets": secrets.op6_secrets,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_mixing": mixing.op8_mixing,
    "op9_neighbors": neighbors.op9_neighbors,
    "op10_minhash": minhash.op10_minhash,
    "op11_resampling": resampling.op11_resampling,
    "op12_extraction": extraction.op12_extraction,
    "op13_prefixes": prefixes.op13_prefixes,
}

ORACLE_SQL = {"op1_fingerprints": fingerprints.OP1_SQL, "op2_warc": warc.OP2_SQL, "op9_neighbors": neighbors.OP9_SQL, "op11_resampling": resampling.OP11_SQL, "op13_prefixes": prefixes.OP13_SQL}
