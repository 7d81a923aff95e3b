"""The pipeline against its stages done by hand."""

import re

import numpy as np
import pytest

import corpus_pipeline as cp
from revledger.llm import packing, pii, quality_rules
from revledger.session import TABLES, read_table
from tests.conftest import SMALL
from tests.llm.conftest import documents
from tests.llm.test_near_dedup import brute
from tests.llm.test_packing import check

W = re.compile(r"[^\x20\x09-\x0D]+")


def failed(text):
    m = dict(zip(quality_rules.MEASURES, quality_rules.measure(text)))
    return (m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
            or m["n_symbols"] > 0.1 * m["n_words"] or m["n_upper"] > 0.5 * m["n_cased"]
            or m["n_dup_lines"] >= 5 and m["n_dup_lines"] > 0.3 * m["n_lines"])


def leaked(text, items):
    words = re.sub(r"[^\w\s]", "", text.lower()).split()
    grams = {tuple(words[i:i + 5]) for i in range(len(words) - 4)}
    for w in items:
        hit = {p for i in range(len(w) - 4) if tuple(w[i:i + 5]) in grams for p in range(i, i + 5)}
        if len(hit) >= 0.5 * len(w):
            return True
    return False


def test_pipeline_matches_its_stages_by_hand(spark):
    pytest.importorskip("public_tokenizers")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in read_table(spark, SMALL, "documents").collect()]
    items = [re.sub(r"[^\w\s]", "", r["text"].lower()).split() for r in read_table(spark, SMALL, "benchmark").collect()]
    rows = [r for r in rows if not failed(r[1])]
    comp = brute(rows, 5, 80)
    rows = [r for r in rows if comp[r[0]][1] == r[0]]
    rows = [(i, pii.mask_text(t), s) for i, t, s in rows if not leaked(t, items)]
    encode = packing.vocabulary_tokens()
    ids = {i: np.append(encode([t])[0], packing.END_ID) for i, t, _ in rows}
    check(cp.run(spark, SMALL).collect(), ids)


def test_stages_return_the_columns_of_documents(spark, odd_rows):
    docs = documents(spark, odd_rows)
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        docs = out
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "near_dedup", "decontamination", "pii", "packing"]
    assert "documents" in TABLES
