"""The queries of the corpus operators, and SQL for those that it can express."""

from __future__ import annotations

from . import bpe, fingerprints, langid, media, packing, quality, simhash, tokencounts, toxicity, warc

QUERIES = {
    f.__name__: f
    for f in (
        fingerprints.op1_fingerprints,
        bpe.op2_bpe,
        toxicity.op3_toxicity,
        simhash.op4_simhash,
        warc.op5_warc,
        media.op6_media,
        tokencounts.op7_token_counts,
        quality.op8_quality,
        packing.op9_packing,
        langid.op10_language,
    )
}
#: Base32 of a SHA-1 in hex: five hex digits make four characters.
BASE32 = "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(s, 1 + CAST(i // 4 AS INT) * 5, 5) AS INT) >> (15 - 5 * CAST(i % 4 AS INT))) & 31 AS INT), 1)), '')"

ORACLE: dict[str, str] = {
    "op5_warc": f"""WITH d AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS s FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY s) AS first FROM d)
SELECT page_id, payload_bytes, {BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""
}
