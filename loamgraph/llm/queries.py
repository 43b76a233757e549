"""The corpus operators' queries and their SQL, for the entry module."""

from __future__ import annotations

from . import chat, extract, media, mixing, near, packing, pii, quality, ranked, resample, search, toxicity, warc

QUERIES = {
    "op1_extract": extract.op1_extract,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_packing": packing.op3_packing,
    "op4_quality": quality.op4_quality,
    "op5_chat": chat.op5_chat,
    "op6_near": near.op6_near,
    "op7_mixing": mixing.op7_mixing,
    "op8_topk": search.op8_topk,
    "op9_warc": warc.op9_warc,
    "op10_media": media.op10_media,
    "op11_pii": pii.op11_pii,
    "op12_ranked": ranked.op12_ranked,
    "op13_resample": resample.op13_resample,
}

ORACLES = {"op5_chat": chat.ORACLE, "op7_mixing": mixing.ORACLE, "op8_topk": search.ORACLE, "op9_warc": warc.ORACLE, "op12_ranked": ranked.ORACLE}
