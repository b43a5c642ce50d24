"""Packs against plain records."""

import hashlib
import unicodedata

from factloom.functions.canonical import canonical
from factloom.operators import packs

TEXTS = {"b.md": "one\r\ntwo\rthree", "a.md": "café " * 400, "c.md": "one\ntwo\nthree", "d.md": None, "e.md": "😀" * 1201}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_pack(spark):
    rows = [(p, path, text) for p in (1, 2) for path, text in TEXTS.items() if p == 1 or path != "b.md"]
    docs = packs.normalized(spark.createDataFrame(rows, "pack_id bigint, relpath string, text string").repartition(3))
    plain = {path: unicodedata.normalize("NFC", (t or "").replace("\r\n", "\n").replace("\r", "\n")) for path, t in TEXTS.items()}
    found = {(r["pack_id"], r["relpath"]): r for r in packs.documents(docs).collect()}
    assert found[1, "b.md"]["doc_id"] == found[1, "c.md"]["doc_id"] == "doc:" + sha("one\ntwo\nthree") and found[1, "a.md"]["bytes"] == 2400
    hashes = {r["pack_id"]: r for r in packs.hashes(docs, "here").collect()}
    for pack in (1, 2):
        texts = {path: t for path, t in sorted(plain.items()) if pack == 1 or path != "b.md"}
        documents = [{"doc_id": "doc:" + sha(t), "relpath": path, "sha256": sha(t), "bytes": len(t.encode())} for path, t in texts.items()]
        chunks = []
        for t in texts.values():
            start, index = 0, 0
            while True:
                end = min(start + 1200, len(t))
                chunks.append({"doc_id": "doc:" + sha(t), "chunk_id": "chunk:" + sha(t[start:end]), "index": index, "offset_start": start, "offset_end": end, "text": t[start:end], "text_sha256": sha(t[start:end])})
                if end == len(t):
                    break
                start, index = start + 1080, index + 1
        record = {"pack_version": "1.0", "root_hint": "here", "pack_sha256": "", "documents": documents, "chunks": chunks}
        assert (hashes[pack]["pack_sha256"], hashes[pack]["n_chunks"]) == (sha(canonical(record)), len(chunks))
