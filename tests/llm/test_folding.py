"""Spellings that fold to the same word, and stems that many benchmark items share."""

import numpy as np
import pyarrow as pa
import pytest
from graphloom.llm import decontam, toxicity


@pytest.mark.parametrize(
    "text",
    ["idiot", "IDIOT", "i\u0308diot", "\U0001d422\U0001d41d\U0001d422\U0001d428\U0001d42d", "\u026a\u1d05\u026a\u1d0f\u1d1b", "\u24d8\u24d3\u24d8\u24de\u24e3", "\u00edd\u00edot", "\u13a5diot", "\uff49\uff44\uff49\uff4f\uff54", "1d10t", "\u0456d\u0456\u043et", "\u03b9d\u03b9o\u03c4", "i\u200bd\u00adiot", "\U0001f178\U0001f173\U0001f178\U0001f17e\U0001f183", "id!ot"],
)
def test_spellings_fold_alike(text):
    assert toxicity.fold(text).split() == ["idiot"]


def test_other_scripts_stay_apart():
    assert toxicity.fold("日本語 と 한국어").split() == [*toxicity.fold("日本語").split(), *toxicity.fold("と").split(), *toxicity.fold("한국어").split()]
    assert toxicity.fold("").split() == [] and toxicity.fold("—!?").split() == []


def hashes(words):
    return decontam.word_hashes(pa.array([" ".join(words)]))[0]


def test_a_stem_that_thousands_of_items_share(monkeypatch):
    stem = [f"stem{k}" for k in range(25)]
    items = [(i, hashes([*stem, *(f"own{i}x{k}" for k in range(15))])) for i in range(3000)]
    held = decontam.Items(items)
    assert sum(len(x[0]) for x in held.by_k.values()) < 3000 * 22  # a shared shingle is there once
    asked = []
    search = decontam.MultiIndex.search
    monkeypatch.setattr(decontam.MultiIndex, "search", lambda self, q: asked.append(len(q)) or search(self, q))
    filler = [f"f{k}" for k in range(30)]
    words, per = decontam.word_hashes(pa.array([" ".join([*filler, *stem] * 200)]))
    assert list(held.search(words, per, 0.8)) == [] and not asked  # no window, as none has enough of an item
    leak = [*filler, *stem, *filler, *stem, *(f"own77x{k}" for k in range(15)), *filler]
    words, per = decontam.word_hashes(pa.array([" ".join(filler), " ".join(leak)]))
    assert [(g[0], g[1], round(g[2], 6), g[3]) for g in held.search(words, per, 0.8)] == [(1, 77, 1.0, 85)]


def test_windows_are_formed_wherever_enough_is_shared():
    pick = np.random.default_rng(5)
    for _ in range(20):
        item = [f"w{k}" for k in pick.integers(0, 500, 40)]
        text = [f"v{k}" for k in pick.integers(0, 500, 60)]
        near = list(item)
        near[int(pick.integers(0, 40))] = "changed"
        at = int(pick.integers(0, 60))
        text[at:at] = near
        words, per = decontam.word_hashes(pa.array([" ".join(text)]))
        found = list(decontam.Items([(1, hashes(item))]).search(words, per, 0.7))
        sizes = 36
        best = 0.0
        own = decontam.shingle_hashes(hashes(item), 5).tolist()
        sh = decontam.shingle_hashes(words, 5).tolist()
        for w in range(len(sh) - sizes + 1):
            mine = sh[w : w + sizes]
            common = sum(min(own.count(s), mine.count(s)) for s in set(own))
            best = max(best, common / (2 * sizes - common))
        assert [round(f[2], 9) for f in found] == ([round(best, 9)] if best >= 0.7 else [])
