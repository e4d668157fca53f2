import itertools
import random
import re

import pytest

from pathsieve.llm import decontaminate as module
from pathsieve.llm.decontaminate import AGREE, MASKS, WINDOW, decontaminate, overlaps


def test_masks_miss_no_passage_with_two_substitutions():
    for gone in itertools.combinations(range(WINDOW), WINDOW - AGREE):
        assert any(not {p + s for p in mask} & set(gone) for mask in MASKS for s in range(WINDOW - max(mask)))


def brute(docs, items):
    words = {}
    for i, t in [*docs, *items]:
        words[t] = [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    out = set()
    for (i, t), (k, b) in itertools.product(docs, items):
        d, w = words[t], words[b]
        width = min(len(w), WINDOW)
        if i is None or k is None or width < 3:
            continue
        need = AGREE if width == WINDOW else -(-width * 85 // 100)
        if any(sum(0 <= o + x < len(d) and d[o + x] == w[x] for x in range(s, s + width)) >= need for o in range(-len(w), len(d)) for s in range(len(w) - width + 1)):
            out.add((i, k))
    return out


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_against_all_offsets(spark, monkeypatch, few):
    monkeypatch.setattr(module, "BROADCAST_SEEDS", few)
    pick = random.Random(11)
    vocabulary = ["word%d" % i for i in range(300)]
    items = [(k, " ".join(pick.choices(vocabulary, k=pick.choice([13, 14, 20, 40])))) for k in range(12)] + [(50, "one two"), (51, "alpha beta, gamma delta"), (52, None), (None, "x y z"), (53, " ".join(vocabulary[:12]))]
    docs = []
    for i in range(120):
        words = pick.choices(vocabulary, k=pick.randint(0, 60))
        if i % 2:
            source = (pick.choice(items[:12])[1]).split()
            a = pick.randint(0, max(0, len(source) - 13))
            part = source[a:a + pick.randint(11, 20)]
            for _ in range(pick.randint(0, 3)):
                part[pick.randrange(len(part))] = "other"
            words[pick.randint(0, len(words)):0] = [w.upper() + "," for w in part]
        docs.append((i, " ".join(words)))
    docs += [(200, None), (201, ""), (202, "Alpha, beta gamma; delta"), (203, "one two"), (None, items[0][1]), (204, "w " * 20_000), (1, docs[1][1])]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, agree int")
    b = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    want = brute(docs, items)
    assert len(want) > 20
    rows = overlaps(d, b).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == sorted(want)
    bad = {i for i, _ in want}
    assert sorted(str(r.doc_id) for r in decontaminate(d, b).collect()) == sorted(str(i) for i, _ in docs if i not in bad)
    assert overlaps(d.limit(0), b).count() == 0 and overlaps(d, b.limit(0)).count() == 0
