import random

import numpy as np
import pytest

from pitchgrid.llm import leakage as L
from pitchgrid.llm.packing import pack, packed_documents, packing_report
from pitchgrid.llm.truncation import _signals, length_spikes, truncation_shares, truncation_signals


def test_pack_keeps_every_constraint():
    tokens = np.random.default_rng(2).integers(1, 900, 3000)
    number = pack(tokens, 1000, 5, 1000 * 1000)  # a cost that cannot bind
    assert (number >= 0).all() and np.bincount(number, weights=tokens).max() <= 1000 and np.bincount(number).max() <= 5
    assert tokens.sum() / (len(set(number)) * 1000) > 0.97
    assert len(pack(np.array([], dtype=int))) == 0 and len(set(pack(np.array([600, 600]), 1000))) == 2


def test_attention_cost_binds():
    """By tokens and places all pieces would share containers that the cost keeps apart; a dear piece is alone."""
    tokens = np.array([900] + [400] * 10 + [50] * 40)
    loose, tight = pack(tokens, 1000, 50, 1_000_000), pack(tokens, 1000, 50, 300_000)
    cost = lambda n: np.bincount(n, weights=tokens.astype(float) ** 2)
    assert cost(loose).max() > 300_000 and len(set(loose)) < len(set(tight))
    several = np.bincount(tight) > 1
    assert cost(tight)[several].max() <= 300_000 and (tight == tight[0]).sum() == 1
    assert np.bincount(tight, weights=tokens).max() <= 1000


def test_packed_documents(spark):
    words = "alpha beta gamma delta".split()
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randrange(1, 60))), "x") for i in range(300)] + [(900, " ".join(words * 100), "x"), (901, "", "x"), (902, None, "x"), (3, "repeat", "x"), (900, " ".join(words * 100), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, container string")
    out = packed_documents(df, capacity=128, max_docs=20, shard=100).toPandas()
    assert out.groupby("container").tokens.sum().max() <= 128 and out.groupby("container").size().max() <= 20
    assert set(out.doc_id) == {*range(300), 900} and not out.duplicated(["doc_id", "piece"]).any()
    assert len(out[out.doc_id == 900]) > 2 and out[out.doc_id != 900].groupby("doc_id").size().max() == 1
    assert packing_report(packed_documents(df, capacity=128, max_docs=20, shard=100), 128).first().unused < 0.25
    assert packed_documents(df.limit(0)).count() == 0


def slow_alignment(doc, item):
    best = 0
    for i in range(len(doc)):
        for j in range(len(item)):
            stack = [(i, j, 0, 0)]
            while stack:
                a, b, n, e = stack.pop()
                if a < len(doc) and b < len(item) and doc[a] == item[b]:
                    if n + 1 > best and n + 1 >= L.ERROR_EVERY * e:
                        best = n + 1
                    stack.append((a + 1, b + 1, n + 1, e))
                if n and e < 2 and a < len(doc):
                    stack.append((a + 1, b, n, e + 1))
                    if b < len(item):
                        stack.append((a + 1, b + 1, n + 1, e + 1))
    return best


@pytest.mark.parametrize("seed", range(6))
def test_alignment_against_brute_force(seed):
    rnd = np.random.default_rng(seed)
    item = rnd.integers(0, 40, 20).astype(np.int32)
    doc = np.concatenate([rnd.integers(0, 40, 4), item[2:18], rnd.integers(0, 40, 3)]).astype(np.int32)
    doc[8] = 77
    doc = np.insert(doc, 12, 78).astype(np.int32)
    other = rnd.integers(0, 40, 9).astype(np.int32)
    runs, _ = L.aligned_runs([doc, other], [item, item], 2)
    assert runs.tolist() == [slow_alignment(doc.tolist(), item.tolist()), slow_alignment(other.tolist(), item.tolist())]


@pytest.mark.parametrize("length", [5, 64, 65, 150])
def test_common_subsequence_against_brute_force(length):
    """Items within one machine word, at its edge and over several."""
    rnd = np.random.default_rng(length)
    items = [rnd.integers(0, 9, length) for _ in range(20)]
    docs = rnd.integers(0, 9, (20, 56)).astype(np.int32)
    used = rnd.random((20, 56)) < 0.9
    index = L.Index([(k, c.astype(np.int32), np.zeros(length, dtype=bool)) for k, c in enumerate(items)], np.ones(L.FEATURES, np.float32), np.ones((L.FEATURES, L.LATENT), np.float32))

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            row = [0] + [last[j] + 1 if x == y else 0 for j, y in enumerate(b)]
            for j in range(1, len(row)):
                row[j] = max(row[j], row[j - 1], last[j])
        return row[-1]

    got = L.common_subsequence(index.numbers(docs), used, index.masks, np.arange(20))
    assert got.tolist() == [slow(docs[k][used[k]].tolist(), items[k].tolist()) for k in range(20)]


def test_word_codes_do_not_depend_on_the_batch():
    texts = ["Die Straße, l'été <b>42</b>&nbsp;Km", "", "東京 Ωmega O'Neil ﬁn", "x" * 70000 + " End"]
    assert [L.words_of(t) for t in texts[:3]] == [["die", "strasse", "lete", "42", "km"], [], ["東京", "ωmega", "oneil", "fin"]]
    whole, counts = L.word_hashes([L.folded(t) for t in texts])
    assert counts.tolist() == [5, 0, 4, 2]
    assert whole.tolist() == [c for t in texts for c in L.word_hashes([L.folded(t)])[0].tolist()]
    assert L.word_hashes([L.folded("a end")])[0][1] == whole[-1] and len(set(whole.tolist())) == 11


ITEM = "Read the passage and answer. The hollow tally that Hizexano proposed after losing 35 duels in Plebristeix moved the hinge nearly 54 metres higher than Flomard wanted."
SAME_BUILD = "The hollow tally that Rexato proposed after losing 71 duels in Quolejaun moved the hinge nearly 12 metres higher than Grilond wanted."


def test_leaks(spark):
    filler = "the home crowd sang through the rain while the tired winger limped off and coach changed shape again late on".split()
    rnd = random.Random(2)
    text = lambda n: " ".join(rnd.choices(filler, k=n))
    quote = "tally that <b>Hizexano</b> PROPOSED, after losing 35 duels in Plébristeix moved the hinge; nearly 55 metres"
    rows = [(i, text(120)) for i in range(60)] + [(100, f"{text(900)} {quote} {text(30)}"), (101, f"{text(20)} {quote} {text(9)}"), (102, f"{text(20)} {quote} {text(9)}"), (103, f"{text(20)} {SAME_BUILD}"), (104, f"{text(9)} after losing 35 duels in Plebristeix moved the hinge {text(5)}"), (105, None), (106, ""), (107, quote), (107, quote)]
    rows[-7] = (102, rows[61][1])
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, words int")
    items = spark.createDataFrame([(1, ITEM), (2, "Read the passage and answer. " + "Given 66 corners, a frugal offside trap and the ledger used by Nostinoux, estimate how many of the 24 headers Nquist won."), (3, None)], "item_id long, item_text string")
    got = {(r.doc_id, r.item_id) for r in L.leaked_items(docs, items).collect()}
    assert got == {(100, 1), (101, 1), (102, 1), (107, 1)}
    assert got == {(r.doc_id, r.item_id) for r in L.leaked_items(docs.unionByName(spark.createDataFrame([(None, quote, 1), (106, quote[:40], 2)], docs.schema)), items).collect()}
    assert L.leaked_items(docs.limit(0), items).count() == 0 and L.leaked_items(docs, items.limit(0)).count() == 0


def test_batches_that_draw_no_passage(spark):
    """A task of blank texts alone, and a sample so thin that batches of a large corpus add nothing to it."""
    leak = "tally that Hizexano proposed after losing 35 duels in Plebristeix moved the hinge nearly 54 metres"
    full = spark.createDataFrame([(1, leak), (2, "the home crowd sang through the rain " * 9)], "doc_id long, text string").coalesce(1)
    blank = spark.createDataFrame([(i, " .") for i in range(10, 14)], full.schema).coalesce(1)
    items = spark.createDataFrame([(1, ITEM)], "item_id long, item_text string")
    assert {(r.doc_id, r.item_id) for r in L.leaked_items(full.union(blank), items).collect()} == {(1, 1)}
    assert L.leaked_items(blank, items).count() == 0
    assert L.fit_sample(L.word_codes(full.union(blank)), 10**12).count() == 0
    assert L.fit_sample(L.word_codes(full.union(blank)), 1).count() == 1 + 4  # 16 and 63 words: 2 and 5 blocks


def test_truncation(spark):
    rows = [(i, "wire", ("word " * 60)[: 118 - i % 3] + ".") for i in range(30)] + [(100 + i, "wire", ("abc defg " * 60)[i : i + 200]) for i in range(12)]
    rows += [(200, "t", "12' Goal - Ana Ruiz\n51' Foul for Eva Diaz"), (201, "t", "Full story told.\nReport by staff"), (202, "t", "Another text.\nReport by staff"), (203, "t", "It ends here.\n(desk/ml)"), (204, "t", "It stops in the midd"), (205, "t", 'She said: "Yes."'), (206, "t", "Done.</p> &nbsp; \n"), (207, "t", ""), (208, "t", None), (209, None, "cut of"), (209, None, "cut of"), (210, "t", "x" * 50000 + " " * 20000), (211, "t", "half a charact�"), (212, "t", "It is over.\nDesk: " + "long list of names, " * 30 + "and one")]
    df = spark.createDataFrame([(i, s, t, 1) for i, s, t in rows], "doc_id long, source string, text string, line int")
    out = truncation_signals(df)
    cause = {r.doc_id: r.cause for r in out.where("truncated").collect()}
    assert cause == {**{100 + i: "limit" for i in range(12)}, 204: "transfer", 209: "transfer", 210: "transfer", 211: "transfer"}
    shares = {r.source: (r.truncated, r.at_limit, r.in_transfer) for r in truncation_shares(out).collect()}
    assert shares["wire"] == (12, 12, 0) and shares["t"] == (3, 0, 3)
    assert truncation_signals(df.limit(0)).count() == 0


def test_spikes_decide_what_looks_finished(spark):
    """Ticker lines and notes at a source's common length are cut, the same lines elsewhere are not."""
    lines = [f"{10 + i % 70}' Foul - Ana {'Ruizdiazkovic' * 3}\n({chr(97 + i % 26) * 160}" for i in range(40)]
    at_limit = [(i, "feed", f"{t[:119]})" if i % 2 else ("12' Goal for " + "Eva Diazkovic " * 20)[:119] + "x") for i, t in enumerate(lines[:12])]
    other = [(100 + i, "feed", "12' Goal for Eva " + "Diaz" * (i % 9 + 1)) for i in range(20)]
    df = spark.createDataFrame(at_limit + other, "doc_id long, source string, text string")
    out = {r.doc_id: r.cause for r in truncation_signals(df).where("truncated").collect()}
    assert out == {i: "limit" for i in range(12)}
    assert [r["at"] for r in length_spikes(_signals(df)).where("measure = 'chars'").collect()] == [120]
