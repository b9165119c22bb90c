import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from helixmark.llm import decontamination as d

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(text, items):
    """(n_words, hit words, items, spans) by comparing all slices."""
    places = [m.span() for m in re.finditer(WORD, lower(text or ""))]
    words = [lower(text)[a:b] for a, b in places]
    hit, found = set(), set()
    for item, t in items:
        w = re.findall(WORD, lower(t or ""))
        for k in range(max(len(w) - 9, min(len(w), 1))):
            part = w[k : k + 10]
            for p in range(len(words) - len(part) + 1):
                if words[p : p + len(part)] == part:
                    hit |= set(range(p, p + len(part)))
                    found.add("" if item is None else str(item))
    spans = []
    for p in sorted(hit):
        if p - 1 in hit:
            spans[-1][1] = places[p][1]
        else:
            spans.append(list(places[p]))
    return len(words), len(hit), sorted(found), spans


def texts(rng, n, words, size):
    return ["".join(rng.choice(words) + rng.choice([" ", ", ", "\n", " - ", "\x00"]) for _ in range(rng.randint(0, size))) for _ in range(n)]


def shown(rows):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_hit"], tuple(r["items"]), tuple((s["start"], s["end"]) for s in r["spans"])) for r in rows)


def wanted(docs, items):
    out = []
    for k, t in docs:
        n, hit, found, spans = brute(t, items)
        out.append((k is None, k or 0, n, hit, tuple(found), tuple(map(tuple, spans))))
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(5)
    words = ["The", "the", "é", "Ünï", "日本", "a1", "B", "c", "x9y", "\U0001f600"]
    items = list(enumerate(texts(rng, 25, words, 16))) + [(90, None), (91, ""), (92, " . "), (93, "short one"), (93, "short one"), (None, "a1 a1 B")]
    base = "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13"
    items += [(94, base), (95, base + " more words of another item here")]
    docs = list(enumerate(texts(rng, 60, words, 60))) + [(200, None), (201, ""), (202, "Short, ONE!"), (202, "Short, ONE!"), (None, f"é… {base.upper()} tail"), (203, "w2 " + base[3:]), (204, "w1 w2 w3 w4 w5 w6 w7 w8 w9")]
    given_ = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = wanted(docs, items)
    assert shown(d.scan(*given_).collect()) == want
    assert shown(d.scan(*given_, words_per_pass=40).collect()) == want  # several passes


def test_long_items_are_cut_into_pieces(spark):
    words = [f"v{k}" for k in range(61)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:17])), (3, " ".join(words[:18]))], "item_id long, text string")
    for a in range(52):
        found = {r["item"] for r in d.pieces(items, piece=7).collect() if f" {' '.join(words[a : a + 10])} " in f" {bytes(r['piece']).decode()} "}
        assert "1" in found and ("2" in found) == (a < 8) and ("3" in found) == (a < 9)


def test_questions_and_answers_are_texts_of_their_own(spark):
    items = spark.createDataFrame([(1, "one two three", "four five")], "item_id long, question string, answer string")
    docs = spark.createDataFrame([(1, "one two three x four five"), (2, "two three four five"), (3, "one two three")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in d.scan(docs, items, ("question", "answer")).collect()}
    assert got == {1: (5, ["1"]), 2: (2, ["1"]), 3: (3, ["1"])}


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_words_and_spans_of_any_text(text):
    data = text.encode("utf-8", "ignore")
    text = data.decode()
    assert [w.decode() for w in d.words_of(data)] == re.findall(WORD, lower(text))
    places = [m.span() for m in re.finditer(WORD, lower(text))]
    assert d.Matcher.spans(data, [x for k in range(len(places)) for x in (k, k + 1)]) == [{"start": a, "end": b} for a, b in places]


def test_symbols_differ_and_avoid_surrogates():
    seen = [symbol for symbol in map(d.symbol, range(70_000))]
    assert len(set(seen)) == 70_000 and "\0" not in seen and not any(0xD800 <= ord(c) < 0xE000 for c in seen)


def test_edge_cases(spark, edge, nothing):
    items = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, None)], "item_id long, text string")
    out = d.scan(edge, items)
    assert set(out.columns) == (set(edge.columns) - {"text"}) | {"n_hit", "items", "spans", "n_words"}
    rows = out.collect()
    assert len(rows) == edge.count() and {r["doc_id"]: r["n_hit"] for r in rows}[4] == 36_000
    assert d.scan(nothing, items).count() == 0
    none = d.scan(edge, items.limit(0)).collect()
    assert len(none) == len(rows) and all(r["n_hit"] == 0 and r["items"] == [] for r in none)
    kept = d.decontaminated(edge, items)
    assert kept.columns == edge.columns and kept.count() == edge.count() - 1
    assert d.decontaminated(edge, items, most=1.0).count() == edge.count()
