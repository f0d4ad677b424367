"""The pipeline's stages against a brute-force version, on the smallest tables."""

import collections
import re

import numpy as np
import pandas as pd

import corpus_pipeline
from quillgrid.llm.queries import tokenizer_file

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SPACE = r"[^\x20\x09-\x0D]+"


def good(t):
    w = re.findall(SPACE, t or "")
    triples = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
    count = collections.Counter(triples)
    covered = {j + k for j, x in enumerate(triples) if count[x] > 1 for k in range(3)}
    return len(w) >= 50 and 100 * len(covered) <= 50 * len(w)


def leaders(docs):
    sets, parent = {}, {}
    for i, t in docs.items():
        w = re.findall(SPACE, (t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            low, high = sorted((len(sets[a]), len(sets[b])))
            if low and 100 * low >= 75 * high and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i for i in docs if find(i) == i}


def clean(docs, bench):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = set()
    for t in bench:
        w = words(t)
        windows |= {tuple(w[k : k + min(10, len(w))]) for k in range(len(w) - min(10, len(w)) + 1 if w else 0)}
    sizes = {len(x) for x in windows}
    return {i for i, t in docs.items() if not any(tuple(w[k : k + n]) in windows for w in [words(t)] for n in sizes for k in range(len(w) - n + 1))}


def test_stages(spark, data, tmp_path):
    from tokenizers import Tokenizer

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "decontamination", "personal data", "tokens"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, outputs = docs.columns, []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        outputs.append(docs.toPandas())
        assert number == 4 or docs.columns == columns
    texts = pd.read_parquet(f"{data}/documents.parquet").set_index("doc_id").text.to_dict()
    kept = {i: t for i, t in texts.items() if good(t)}  # so few labels certify no cutoff
    assert sorted(outputs[0].doc_id) == sorted(kept)
    kept = {i: kept[i] for i in leaders(kept)}
    assert sorted(outputs[1].doc_id) == sorted(kept)
    kept = {i: kept[i] for i in clean(kept, pd.read_parquet(f"{data}/benchmark.parquet").text)}
    assert sorted(outputs[2].doc_id) == sorted(kept)
    redacted = outputs[3].set_index("doc_id")
    assert sorted(redacted.index) == sorted(kept)
    for i, t in redacted.text.items():
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t) and redacted.n_chars[i] == len(t)
        assert t == kept[i] or "[" in t
    library = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    for r in outputs[4].itertuples():
        ids = library.encode(redacted.text[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids == np.array(ids, "<u4").tobytes() and r.decoded == redacted.text[r.doc_id]
