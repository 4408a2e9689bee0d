"""A token-level classifier of hesitations: boosted trees over the form, the language and the place of a token."""

from __future__ import annotations

import re
import unicodedata
from functools import cache
from itertools import groupby, product

import numpy as np

from lakeloom.llm.boosting import BoostedTrees

# Labelled forms by language. Hesitations are non-lexical sounds; interjections that answer are words.
HESITATIONS = {
    "zh": "嗯 呃 啊 哦 诶 唔 噢 喔 欸 额 呣 哎 唉 嗯嗯 呃呃 啊啊 哦哦 诶诶 嗯啊 呃嗯",
    "en": "um umm uh uhh uhm er err erm eh ehm ah ahh ahm hm hmm mm mmm mhm",
    "de": "äh ähh ähm ähmm öh öhh öhm üh hm hmm mm mmm mhm ah ahm eh ehm uh uhm",
}
WORDS = {
    "zh": "对 好 是 行 有 没 我 你 来 嗨 喂 好的 对啊 是啊 好啊 好嗯 谢谢 可以 没有 没问题 几点了 额头 啊呀呀我 知道 等一下 嗯我 哎呀 听说",
    "en": "a i am an at he her hear here him hum me mum my us use run ear are era arm ham hen hare mere more ok okay yes yeah no now oh right sure well so the thanks hello true there rum harm hammer umbrella error merm humour",
    "de": "er um am an im ehe eher ehre uhr mehr ihm ihr ihn nur rum nun ja nein ach oh so gut genau haben hammer umher meer nehme ohm arm ärmer höhe müh mühe uhren rahm ehren ok danke richtig moment",
}
_CHARACTERS = frozenset("嗯呃啊哦诶唔噢喔欸额呣哎唉")
_VOWELS, _SOUNDS = frozenset("aeiouäöüy"), frozenset("hm")
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_TAIL = re.compile(r"[ ]*(?:\.{2,}|…+|[,，.。、~～—-])?")
_PAUSE = re.compile(r"\s*(?:\.{2,}|…|[,，、~～—-])")
LANGUAGES = ("zh", "en", "de")
# Where a token stands: first in its utterance, alone in it, before a pause mark, beside the same form.
PLACES = list(product((False, True), repeat=4))


def form_features(form: str, language: str) -> tuple[float, ...]:
    """What a form tells: its sounds once repeats are collapsed, its characters, and the language around it."""
    word = "".join(k for k, _ in groupby(unicodedata.normalize("NFKC", form).casefold()))
    n = len(word)
    vowels = sum(c in _VOWELS for c in word)
    after = word.lstrip("aeiouäöü")
    return (
        float(min(n, 12)),
        sum(c in _CHARACTERS for c in word) / n,
        float(vowels),
        float(n - len(after)),
        float(all(c in _SOUNDS for c in after)),
        float(after in ("r", "rm")),
        float("h" in word),
        float(len(form) > n),
        *(float(word[:1] == c) for c in "aeiou"),
        float(any(c.isdigit() for c in word)),
        *(float(language == k) for k in LANGUAGES),
    )


class FillerModel:
    """Decides every token of a text; forms and places met before are looked up, so a batch asks the trees rarely. What
    the driver met while it read the training sample goes to the workers with the trees."""

    def __init__(self, trees: BoostedTrees):
        self.trees = trees
        self.known: dict[tuple, int] = {}
        self.forms: dict[tuple, int] = {}

    def __getstate__(self):
        return {"trees": self.trees, "known": self.known, "forms": {}}

    def places(self, form: str, language: str) -> int:
        """A bit for each of PLACES, set where the form is a hesitation; 0 for a form that is a word everywhere."""
        got = self.forms.get((form, language))
        if got is None:
            f = form_features(form, language)
            got = self.known.get(f)
            if got is None:
                got = self.known[f] = sum(self.trees.decide([*f, *p]) << i for i, p in enumerate(PLACES))
            if len(self.forms) < 200_000:
                self.forms[form, language] = got
        return got

    def decide(self, form: str, language: str, first: bool = True, alone: bool = True, pause: bool = False, repeated: bool = False) -> bool:
        return bool(self.places(form, language) >> PLACES.index((first, alone, pause, repeated)) & 1)

    def removed(self, text: str, language: str = "und") -> str:
        """The text with each hesitation, and the pause mark after it, replaced by a space."""
        found = list(_TOKEN.finditer(text))
        out, last = [], 0
        for i, m in enumerate(found):
            form, end = m.group(), m.end()
            places = self.places(form, language)
            if places:
                beside = (i > 0 and found[i - 1].group() == form) or (i + 1 < len(found) and found[i + 1].group() == form)
                at = PLACES.index((i == 0, len(found) == 1, _PAUSE.match(text, end) is not None, beside))
                if places >> at & 1:
                    out += [text[last : m.start()], " "]
                    last = _TAIL.match(text, end).end()
        return "".join(out) + text[last:] if out else text


def labelled_rows(hesitations: dict[str, str] = HESITATIONS, words: dict[str, str] = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Every labelled form in its language, and in texts of no known language unless a word there, in every place."""
    x, y = [], []
    lexical = {w for ws in words.values() for w in ws.split()}
    sounds = {w for ws in hesitations.values() for w in ws.split()}
    for label, forms in ((1.0, hesitations), (0.0, words)):
        for language, ws in forms.items():
            for w in ws.split():
                others = [k for k in (*LANGUAGES, "und") if k != language and not (label and w in words.get(k, "").split()) and not (not label and w in sounds)]
                for k in [language, *others]:
                    if label == 1.0 and k == "und" and w in lexical and w not in hesitations["en"].split():
                        continue
                    for place in PLACES:
                        x.append([*form_features(w, k), *place])
                        y.append(label)
    return np.array(x), np.array(y)


@cache
def train_fillers() -> FillerModel:
    """The classifier fitted on the labelled forms, a bounded set."""
    return FillerModel(BoostedTrees(trees=60, depth=5, rate=0.3, min_leaf=2).fit(*labelled_rows()))
