"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from . import collisions, images, interpolation, jaccard, language, licenses, lloyd, oracle, packing, resampling, secret_scan, segmentations, suffixes, token_store

QUERIES = {
    "op1_images": images.op1_images,
    "op2_collisions": collisions.op2_collisions,
    "op3_jaccard": jaccard.op3_jaccard,
    "op4_secrets": secret_scan.op4_secrets,
    "op5_language": language.op5_language,
    "op6_token_store": token_store.op6_token_store,
    "op7_interpolation": interpolation.op7_interpolation,
    "op8_packing": packing.op8_packing,
    "op9_segmentations": segmentations.op9_documents,
    "op10_suffixes": suffixes.op10_suffixes,
    "op11_licenses": licenses.op11_licenses,
    "op12_lloyd": lloyd.op12_lloyd,
    "op13_resampling": resampling.op13_resampling,
}

ORACLE_SQL = oracle.ORACLE_SQL
