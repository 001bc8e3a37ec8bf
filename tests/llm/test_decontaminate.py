"""Decontamination against brute force over all item-sized windows."""

import random
import re
from collections import Counter

from tidemark.llm import decontaminate as module
from tidemark.llm.decontaminate import SHINGLE, THRESHOLD, contaminated, decontaminate


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def shingles(ws, k):
    return Counter(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))


def similarity(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def brute(docs, items):
    found = {}
    for d, text in docs:
        ws = words(text)
        for i, item in items:
            iw = words(item)
            if not iw or not ws:
                continue
            k, size = min(SHINGLE, len(iw)), min(len(iw), len(ws))
            theirs = shingles(iw, k)
            best = max(((similarity(shingles(ws[s : s + size], k), theirs), -s) for s in range(len(ws) - size + 1) if size >= k), default=(0, 0))
            if best[0] >= THRESHOLD:
                found[d, i] = (-best[1], round(best[0], 9))
    return found


def run(table, docs, items):
    got = contaminated(table("doc_id long, text string", docs), table("item_id long, text string", items)).collect()
    return {(r.doc_id, r.item_id): (r.start, round(r.similarity, 9)) for r in got}


def cases(rng):
    vocabulary = [f"v{i}" for i in range(60)]
    said = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [said(n) for n in (3, 5, 8, 14, 20, 31, 45, 59, 59, 120)]
    items.append(["the", "cat"] * 12)  # repeated shingles
    docs = []
    for k, item in enumerate(items * 6):
        quote = list(item)
        for _ in range(k // len(items) % 4):  # none to three edits
            at = rng.randrange(len(quote))
            rng.choice([lambda: quote.pop(at), lambda: quote.insert(at, "new"), lambda: quote.__setitem__(at, "other")])()
        docs.append(said(rng.randrange(0, 80)) + quote + said(rng.randrange(0, 80)))
    docs += [items[7][:50], items[7][5:], items[6] + items[6], said(400)]
    mixed = [(i, " ".join(w.upper() if rng.random() < 0.2 else w for w in d).replace(" ", rng.choice([" ", ", ", "\n"]))) for i, d in enumerate(docs)]
    return mixed, [(i, " ".join(w) + ".") for i, w in enumerate(items)]


def test_brute_force(table):
    docs, items = cases(random.Random(3))
    docs += [(900, None), (901, ""), (902, "?!"), (903, "v1 " * 3000)]
    items += [(90, None), (91, ""), (92, items[3][1])]
    assert run(table, docs, items) == brute(docs, items)


def test_rows_of_contaminated_documents_go(table):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, f"before {item} after", "m", 0), (1, "clean text here", "m", 0), (None, item, None, 1), (None, "fine", None, 1), (2, f"x {item.upper()}", "m", None), (2, f"x {item.upper()}", "m", None), (3, None, "th", 2)]
    df = table("doc_id long, text string, id string, m int", docs)
    bench = table("item_id long, text string", [(7, item)])
    out = decontaminate(df, bench)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted([(1, "clean text here"), (None, "fine"), (3, None)], key=repr)
    assert decontaminate(df, bench.where("false")).count() == len(docs)
    assert decontaminate(df.where("false"), bench).collect() == []


def test_quotes_filled_up_with_one_word(table):
    """A quote that lacks its end, in a page of one repeated word (or two in turn)."""
    items = [(k, " ".join(f"q{k}w{i}" for i in range(m))) for k, m in enumerate([31, 60, 90, 120] * 6)]
    fill = lambda k, n: (["na"] * n if k % 3 else ["na", "hey"] * n)[:n]
    docs = []
    for k, item in items:
        ws = item.split()
        docs.append((100 + k, " ".join(fill(k, 40) + ws[: len(ws) - (len(ws) - 4) // 10] + fill(k, 40))))
    want = brute(docs, items)
    assert len(want) == len(items)
    assert run(table, docs, items) == want


def test_anchors_met_by_exchange_give_the_same(table, monkeypatch):
    monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    docs, items = cases(random.Random(9))
    assert run(table, docs, items) == brute(docs, items)
