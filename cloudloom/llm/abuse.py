"""Abusive, hateful and sexual content: a lexicon met through Levenshtein automata, judged in its context.

Each word of a text is turned into a Levenshtein automaton (one edit from five letters, two from nine; a swap of
neighbours is one edit; digits and signs stand for the letters they look like) and run against the trie of
all lexicon words, so misspelled and masked terms are met without listing them. Edits that easily make another word (in
words of five letters, or at the first or last letter) are guesses, taken only next to what bears them out (``SUPPORT``). Japanese terms are met the same way from every place in a text, in any kana. Words and phrases met have
classes: insults, attacks, harm, groups, degrading words, explicit words, and those that set the context, as who is
addressed, what is wished, what is offered, what is only told of others or said of goods. A hit is scored by the
classes in its window, within its sentence; report and goods words nearby take the score down, and so do quotation marks in a
sentence that says somebody said it. A document's
score is that of its highest hit, per category (abuse, hate, sexual).

How it scales: one pass without a shuffle of texts; a task keeps the matches of the words it met last, and looks closer only at sentences with a word that can score. Rates per source are one aggregation.
A text's scores depend on nothing but itself: what counts as an ordinary word is a fixed list (``INNOCENT`` and the whole words of the
tokenizer's vocabulary), not what is frequent in the table.

Defined cases: null, blank and CJK-free empty texts score 0; texts are taken whole, in pieces of sentences; the language is judged per
sentence, then per text, then by the lang column; repeated ids are scored each; other columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.llm import tokens
from cloudloom.llm.lexicon import INNOCENT, KANA_MASKS, LOOKALIKES, MASKS, SAYING, TERMS
from cloudloom.runtime import spread

#: Score from which a document counts as abusive, hateful or sexual.
LIMIT = 0.6
#: Share of documents, and least number, from which a word near a lexicon word is reported as frequent.
ORDINARY_SHARE, ORDINARY_LEAST = 0.0005, 10

#: Classes that bear out a guessed word of a class: (class, words before it, words after it).
_THROWN = (("you", 3, 1), ("slur", 2, 1), ("wish", 6, 0), ("vocative", 0, 1), ("insult", 3, 3), ("attack", 4, 4))
SUPPORT = {
    "insult": _THROWN, "jibe": _THROWN, "attack": _THROWN, "slur": (("insult", 0, 2), ("jibe", 0, 2)), "harm": (("wish", 6, 0),), "blow": (("wish", 6, 0),),
    "group": (("degrade", 6, 6),), "degrade": (("group", 6, 6),), "belittle": (("group", 6, 6),),
    "explicit": (("explicit", 6, 6), ("offer", 6, 6), ("you", 3, 1)), "bodily": (("explicit", 6, 6), ("offer", 6, 6)),
}

#: Classes that only set the context of others: a text without any other class scores 0.
CONTEXT = frozenset(("you", "person", "self", "claim", "heat", "offer", "report", "goods", "wish", "slur", "degrade", "belittle", "body", "absence", "better", "place"))

#: Characters of Japanese that count as a word in windows.
CJK_WORD = 2.5
#: Characters of a Japanese term from which one edit is allowed.
CJK_EDIT = 5

#: Longest word whose results are kept for the next time it is met.
_KEPT = 64

#: Endings a single word of a language may take.
ENDINGS = {"en": ("s", "es"), "de": ("e", "en", "er", "es", "em", "n", "s"), "fr": ("s", "e", "es"), "es": ("s", "es"), "ja": ()}
#: Function words that tell the language of a sentence.
FUNCTION_WORDS = {
    "en": "the and is it i you to of for this that was with not my have are on in at will so they what all your who from just would should do off up hope be",
    "de": "der die das und ist ich du nicht ein eine mit für von zu es den dem auf sich im doch ihr wir sind alle dich dir mir habe wird halt so so was beim von bis zum zur als auch nur noch wie aber oder wenn",
    "fr": "le la les un une et est je tu ne pas de des du pour avec ce cette que qui il elle on sur dans nous vous sont mon ma ta toi sans au aux te se son ses leur leurs mais ou où donc plus très bien été",
    "es": "el la los las un una y es yo tú no de del para con este esta que se en lo por mi su son está muy al te eres vete hay ese esa como hoy quieren",
}
_JA_ENDS = " \t\n。、！？!?.…ーっッ"
_LETTERS = re.compile(r"[^\W\d_]")
#: Words put between quotation marks; each is marked, to tell what is said by others.
_QUOTED = re.compile("\"[^\"\n]{1,300}\"|“[^”\n]{1,300}”|„[^“”\n]{1,300}[“”]|«[^»\n]{1,300}»|「[^」\n]{1,300}」|『[^』\n]{1,300}』|(?<!\\w)['‘][^'’\n]{3,300}['’](?!\\w)")
_MARK = "\x01"
_STARTS = re.compile(r"\b(?=\w)")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_SENTENCE = re.compile(r"[^.!?。！？\n]*(?:[.!?。！？\n]+|$)")
_WORD = re.compile(r"[^\s.,;:?\"“”„«»()<>/\\\-–—、。！？「」…~=+\[\]{}]+")
#: A name called at the end of a sentence: ", you old fool!"
_CALLED = re.compile(r",\s*(?:[^\s,]+\s+){0,2}[^\s,]+\s*[.!?]*\s*$")
#: A word spelled with signs between its letters: "f.u.c.k"
_SPELLED = re.compile(r"(?<!\w)(?:(?:[^\W\d_][.\-_·*]){2,}|(?:[^\W\d_] ){2,})[^\W\d_](?!\w)")
#: Characters without a width: soft hyphen, joiners, marks of direction.
_INVISIBLE = re.compile("[\u00ad\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff\ufff9-\ufffb]")
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_WRONG = re.compile("[ÃÂãåæçèéä][\u0080-¿Œ-Ÿ–-™]")


def fold(word: str) -> str:
    """Lower case without accents (Latin letters only; kana keep their marks)."""
    return _fold(word) if len(word) <= _KEPT else _fold.__wrapped__(word)


@lru_cache(maxsize=200_000)
def _fold(word: str) -> str:
    word = word.casefold()
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def fold_kana(text: str) -> str:
    """Katakana as hiragana; everything else, and every length, stays."""
    return text.translate(_HIRAGANA)


_HIRAGANA = {k: k - 96 for k in range(0x30A1, 0x30F7)}


def repair(text: str) -> str:
    """Undo UTF-8 read as a Western code page, markup, look-alike and invisible characters."""
    if _WRONG.search(text):
        raw = bytearray()
        for c in text:
            try:
                raw += c.encode("cp1252")
            except UnicodeEncodeError:
                raw += bytes([ord(c)]) if ord(c) < 256 else c.encode("utf-8", "replace")
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            pass
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).replace("’", "'")
    return _SPELLED.sub(lambda m: re.sub(r"[.\-_·* ]", "", m[0]), text)


@lru_cache(maxsize=1)
def real_words() -> frozenset[str]:
    """Words of the tokenizer's vocabulary, folded: a fixed list of common words of several languages."""
    whole = (t[1:] for t in tokens.vocabulary() if t[:1] == " " and len(t) > 4 and t[1:].isalpha())
    return frozenset(fold(t) for t in whole)


class Lexicon:
    """Terms by class, the trie of their words, and the automata run against it."""

    def __init__(self, terms: dict[str, dict[str, str]] = TERMS):
        self.phrases: dict[str, list[tuple[tuple[str, ...], str, str]]] = defaultdict(list)
        self.cjk: dict[str, list[tuple[str, str]]] = defaultdict(list)
        loose: set[str] = set()
        for cls, by_lang in terms.items():
            for lang, listed in by_lang.items():
                for term in filter(None, (t.strip() for t in listed.split(","))):
                    if lang == "ja":
                        self.cjk[fold_kana(term)].append((term, cls))
                        continue
                    words = tuple(fold(w) for w in _WORD.findall(term))
                    forms = {words}
                    if len(words) == 1 and len(words[0]) > 2:
                        forms |= {(words[0] + e,) for e in ENDINGS[lang]}
                        if lang == "en" and words[0].endswith("y"):
                            forms.add((words[0][:-1] + "ies",))
                    elif len(words) > 1:
                        # the last word of a phrase may be in the plural
                        forms.add((*words[:-1], words[-1] + "s"))
                    for f in forms:
                        self.phrases[f[0]].append((f, cls, lang))
                    if cls not in ("you", "self", "claim", "heat", "goods", "report"):
                        loose.update(words)
                        loose.update(f[-1] for f in forms)
        words = {w for found in self.phrases.values() for f, _, _ in found for w in f}
        self.words = words
        self.innocent = {fold(w.strip()) for w in INNOCENT.split(",")} | {fold(w) for text in FUNCTION_WORDS.values() for w in text.split()}
        #: A trie for each length of word, so that the automaton of a token meets only words of about its length.
        self.tries: dict[int, dict] = {}
        for w in words:
            _insert(self.tries.setdefault(len(w), {}), w, w in loose)
        self.kana: dict = {}
        for w in self.cjk:
            _insert(self.kana, w, True)
        self.kana_starts = frozenset(w[0] for w in self.cjk) | frozenset(c for c, others in KANA_MASKS.items() if any(w[0] in others for w in self.cjk))
        self.longest = max(map(len, words), default=0)
        self.longest_kana = max(map(len, self.cjk), default=0)
        self._seen = lru_cache(maxsize=200_000)(self._see)
        self._begun = lru_cache(maxsize=200_000)(self._begin)
        #: Beginnings, ends and inner pieces of words: a token within an edit or two of a word shares one of them with it.
        self.heads = frozenset(w[:k] for w in words for k in range(len(w) + 1))
        self.tails = frozenset(w[k:] for w in words for k in range(len(w) + 1))
        self.grams = frozenset(w[i : i + k] for w in words for k in range(2, 12) for i in range(len(w) - k + 1))
        self._known = lru_cache(maxsize=200_000)(self._know)

    def known(self, token: str) -> tuple[str, tuple[int, ...], tuple, bool]:
        """Of a word as it is written: the bare word, the languages it is a function word of, phrases it may begin, and whether one of them can score."""
        return self._known(token) if len(token) <= _KEPT else self._know(token)

    def _know(self, token: str) -> tuple[str, tuple[int, ...], tuple, bool]:
        word = _bare(token)
        begun = self.begun(word) if word else ()
        return word, _function_words().get(fold(word), ()), begun, any(p[1] not in CONTEXT for p in begun)

    def begins_kana(self, text: str) -> bool:
        return not text.isascii() and not self.kana_starts.isdisjoint(fold_kana(text))

    def met(self, token: str) -> dict[str, int]:
        return self.seen(token)[0]

    def seen(self, token: str) -> tuple[dict[str, int], dict[str, int]]:
        """Lexicon words the token may stand for, with their edits: those met, and those guessed if none is met."""
        return self._seen(token) if len(token) <= _KEPT else self._see(token)

    def begun(self, token: str) -> tuple:
        return self._begun(token) if len(token) <= _KEPT else self._begin(token)

    def _begin(self, token: str) -> tuple[tuple[tuple[str, ...], str, str, int, bool], ...]:
        """Phrases a token may begin: (words, class, language, edits, guessed)."""
        met, guessed = self.seen(token)
        return tuple((*p, edits, got is guessed) for got in (met, guessed) for w, edits in got.items() for p in self.phrases.get(w, ()) if got is met or p[1] in SUPPORT)

    def misspelt(self, token: str) -> bool:
        """True if the token is met only by taking it for a misspelling."""
        return any(self.met(token).values())

    def _see(self, token: str) -> tuple[dict[str, int], dict[str, int]]:
        token = fold(token)
        if token in self.words:
            return {token: 0}, {}
        short = re.sub(r"(.)\1{2,}", r"\1\1", token)
        for t in {short, re.sub(r"(.)\1+$", r"\1", short), re.sub(r"(.)\1{2,}", r"\1", token)}:
            if t != token and t in self.words:
                return {t: 0}, {}
        if len(token) > self.longest + 2:
            # no term is within two edits
            return {}, {}
        letters = len(_LETTERS.findall(token))
        masked = letters < len(token.replace("'", ""))
        if masked:
            if letters == 0 or len(token) < 3:
                return {}, {}
            sets = [MASKS.get(c, c) for c in token]
            got = self._run(sets, 0)
            # a mask must leave the word to be recognised: half of it, or both ends
            ends = letters >= 2 and len(token) >= 4 and token[0].isalpha() and token[-1].isalpha()
            return {w: 0 for w in got if ends or letters * 2 >= len(w)}, {}
        if len(token) < 4 or token in self.innocent:
            return {}, {}
        edits = 2 if len(token) >= 9 else 1
        # the vocabulary holds beginnings of words too: those may be terms cut short
        if token in real_words():
            got = self._begin_with(token, edits)
        else:
            got = self._run(list(token), edits) if self._shares(token, edits) else {}
        sure = {w: k for w, k in got.items() if self._may_be(w, token, k)}
        least = min(sure.values(), default=0)
        if sure:
            return {w: k for w, k in sure.items() if k == least}, {}
        # swapped letters of a word of four are met above
        got = {w: k for w, k in got.items() if len(w) >= (5 if k == 1 else 9)}
        least = min(got.values(), default=0)
        return {}, {w: k for w, k in got.items() if k == least}

    @staticmethod
    def _may_be(word: str, token: str, edits: int) -> bool:
        if sorted(word) == sorted(token):
            return len(word) >= 4
        # a change in a short word makes another word, and so does a new ending or beginning: those are only guessed
        return len(word) >= 6 and word[0] == token[0] and (edits == 1 or len(word) >= 9) and word[:-1] != token and token[:-1] != word and word[:-1] != token[:-1]

    def _shares(self, token: str, most: int) -> bool:
        """False if no word can be within ``most`` edits. An edit touches two neighbours at most, so of pieces with a gap between them one more than edits stays whole."""
        n = len(token)
        h = (n - most) // (most + 1)
        if token[:h] in self.heads or token[n - h :] in self.tails:
            return True
        middle = (n - h) // 2
        return most == 2 and (token[middle : middle + h] in self.grams or h < 2)

    def _begin_with(self, token: str, most: int) -> dict[str, int]:
        """Words that are the token and up to ``most`` letters more."""
        found = {}
        for k in range(most + 1):
            node = self.tries.get(len(token) + k)
            for c in token:
                node = node and node.get(c)
            stack = [node] if node else []
            while stack:
                node = stack.pop()
                if (w := node.get("")) is not None:
                    found[w] = k
                stack += [child for c, child in node.items() if c]
        return found

    def _run(self, sets: list[str], most: int) -> dict[str, int]:
        """Meets the words with the automaton of ``sets`` (one string of letters per place, empty for any letter): word -> edits."""
        n = len(sets)
        found: dict[str, int] = {}
        for length in range(max(1, n - most), n + most + 1):
            if (trie := self.tries.get(length)) is not None:
                for w, k, at in _meet(trie, sets, most, length):
                    if at == n:
                        found[w] = min(k, found.get(w, most))
        return found

    def in_kana(self, text: str) -> list[tuple[int, int, str, str, int]]:
        """Japanese terms in a text: (first, last, term, class, edits), edits -1 for a term that is written as it is.

        From every place where a term may begin the automaton of what follows meets the trie of terms. Katakana stand for
        hiragana, some characters for others (``KANA_MASKS``), and terms from ``CJK_EDIT`` characters may have one edit after the first.
        """
        soft, out = fold_kana(text), []
        for i, c in enumerate(soft):
            if c not in self.kana_starts:
                continue
            window = soft[i : i + self.longest_kana + 1]
            sets = ["" if KANA_MASKS.get(x) == "" else x + KANA_MASKS.get(x, "") for x in window]
            best: dict[str, tuple[int, int]] = {}
            for first in sets[0]:
                if (after := self.kana.get(first)) is not None:
                    for w, k, at in _meet(after, sets[1:], 1):
                        if k <= (len(w) >= CJK_EDIT) and (k, at + 1) < best.get(w, (9, 0)):
                            best[w] = (k, at + 1)
            for w, (k, at) in best.items():
                for term, cls in self.cjk[w]:
                    plainly = text.startswith(term, i)
                    if plainly or any(x and x in w for x in soft[i : i + at]):
                        out.append((i, i + (len(term) if plainly else at) - 1, term, cls, -1 if plainly else k))
        return out


def _insert(trie: dict, word: str, counts: bool) -> None:
    for c in word:
        trie = trie.setdefault(c, {})
    trie[""] = word if counts else None


def _meet(trie: dict, sets: list[str], most: int, length: int | None = None) -> list[tuple[str, int, int]]:
    """Intersects a trie with the Levenshtein automaton of ``sets``, up to two edits: (word, edits, places of ``sets`` it takes up).

    A state holds, for every number of edits, the bit set of places reached (a, b, c), and the places where a swap of neighbours is half done (p, q).
    If all words have ``length`` letters and must take up all places, places from which the rest can't be reached are left out.
    """
    n = len(sets)
    full, anyone, at = (1 << n) - 1, 0, {}
    for i, letters in enumerate(sets):
        if not letters:
            anyone |= 1 << i
        for x in letters:
            at[x] = at.get(x, 0) | 1 << i
    one, two = most > 0, most > 1
    if length is None:
        bands = None
    else:
        middle = [n - length + d for d in range(length + 1)]
        bands = [tuple(sum(1 << i for i in range(max(0, m - r), min(n, m + r) + 1)) for r in (most, most - 1, most - 2)) for m in middle]
    found = []
    stack = [(trie, 0, 1, 3 if one else 0, 7 if two else 0, 0, 0)]
    while stack:
        node, depth, a, b, c, p, q = stack.pop()
        depth += 1
        for x, child in node.items():
            if not x:
                if child is not None:
                    for k, reached in enumerate((a, b, c)):
                        while reached:
                            low = reached & -reached
                            found.append((child, k, low.bit_length() - 1))
                            reached ^= low
                continue
            here = at.get(x, 0) | anyone
            na = (a & here) << 1
            nb = nc = np = nq = 0
            if one:
                nb = ((b & here) << 1) | a | ((a & full) << 1) | ((na & full) << 1) | ((p & here) << 2)
                np = a & (here >> 1) & (full >> 1)
                if two:
                    nc = ((c & here) << 1) | b | ((b & full) << 1) | ((nb & full) << 1) | ((q & here) << 2)
                    nq = b & (here >> 1) & (full >> 1)
            if bands is not None:
                ma, mb, mc = bands[depth]
                na, nb, nc = na & ma, nb & mb, nc & mc
            if na or nb or nc or np or nq:
                stack.append((child, depth, na, nb, nc, np, nq))
    return found


@lru_cache(maxsize=1)
def lexicon() -> Lexicon:
    return Lexicon()


@lru_cache(maxsize=1)
def _function_words() -> dict[str, tuple[int, ...]]:
    """Function word -> positions of its languages."""
    out: dict[str, list[int]] = defaultdict(list)
    for k, text in enumerate(FUNCTION_WORDS.values()):
        for w in {fold(w) for w in text.split()}:
            out[w].append(k)
    return {w: tuple(ks) for w, ks in out.items()}


def _tally(languages: Iterable[tuple[int, ...]]) -> list[int]:
    """Function words per language, in the order of FUNCTION_WORDS."""
    counts = [0] * len(FUNCTION_WORDS)
    for ks in languages:
        for k in ks:
            counts[k] += 1
    return counts


def _best(tally: list[int], least: int) -> list[str]:
    top = max(tally)
    return [lang for lang, n in zip(FUNCTION_WORDS, tally) if n == top] if top >= least else []


def declared(lang: str | None) -> list[str]:
    code = (lang or "")[:2].lower()
    return [code] if code in FUNCTION_WORDS else []


def _join_spelled(words: list[str]) -> list[str]:
    """Words spelled letter by letter ("b i t c h") as one."""
    if sum(len(w) == 1 for w in words) < 3:
        return words
    out, run = [], []
    for w in [*words, ""]:
        if len(w) == 1 and w != "":
            run.append(w)
            continue
        if len(run) >= 3:
            out.append("".join(run))
        else:
            out.extend(run)
        run = []
        if w:
            out.append(w)
    return out


def _bare(token: str) -> str:
    w = token.replace(_MARK, "").strip("'!*#|%_")
    if w and not w.isascii() and any("a" <= c <= "z" for c in w.lower()):
        w = w.translate(LOOKALIKES)
    return w


def _words(sentence: str) -> list[str]:
    return _join_spelled([w for w in map(_bare, _WORD.findall(sentence)) if w])


def _quoted(sentence: str) -> set[int]:
    """Numbers of the words between quotation marks."""
    if _MARK not in sentence:
        return set()
    kept = [t for t in _WORD.findall(sentence) if _bare(t)]
    # words spelled letter by letter are one, so numbers only hold without them
    return {k for k, t in enumerate(kept) if _MARK in t} if len(kept) == len(_words(sentence)) else set()


@lru_cache(maxsize=1)
def _saying() -> tuple[frozenset[str], tuple[str, ...]]:
    return frozenset(fold(w.strip()) for lang, listed in SAYING.items() if lang != "ja" for w in listed.split(",")), tuple(w.strip() for w in SAYING["ja"].split(","))


class _Hits:
    """Class hits of a sentence: (first, last, edits) by class, and distances between them."""

    def __init__(self):
        self.by: dict[str, list[tuple[float, float, int]]] = defaultdict(list)
        #: Places of words that are quoted from others.
        self.quoted: set[float] = set()

    def add(self, cls: str, first: float, last: float, edits: int) -> None:
        self.by[cls].append((first, last, edits))

    def supported(self, cls: str, hit) -> bool:
        """True if a guessed hit stands near what bears it out."""
        return any(self.near(c, hit, before, -1) or self.near(c, hit, after, 1) for c, before, after in SUPPORT[cls])

    def near(self, cls: str, hit, within: int, side: int = 0) -> bool:
        """A hit of ``cls`` within so many words; side 1: only after, -1: only before. The hit's own words don't count."""
        for o in self.by.get(cls, ()):
            if o[0] <= hit[1] and hit[0] <= o[1]:
                continue
            gap = o[0] - hit[1] if o[0] > hit[1] else hit[0] - o[1]
            if gap <= within and (side == 0 or (side > 0) == (o[0] > hit[1])):
                return True
        return False

    def others(self, cls: str, hit, within: int) -> int:
        return sum(1 for o in self.by.get(cls, ()) if not (o[0] <= hit[1] and hit[0] <= o[1]) and min(abs(o[0] - hit[1]), abs(hit[0] - o[1])) <= within)


def _find(words: list[str], phrases: list[tuple[int, tuple]], sentence: str, langs: list[str]) -> _Hits | None:
    """Hits in a sentence: its words, and by place the phrases that may begin there."""
    lex, hits, n = lexicon(), _Hits(), len(words)
    guesses: list[tuple[str, tuple[int, int, int]]] = []
    for i, begun in phrases:
        longest: dict[str, int] = {}
        for f, cls, lang, total, guess in begun:
            k = len(f)
            if lang not in langs or i + k > n or longest.get(cls, 0) >= k:
                continue
            for j in range(1, k):
                met, guessed = lex.seen(words[i + j])
                if f[j] in met:
                    total += met[f[j]]
                elif f[j] in guessed and cls in SUPPORT:
                    total += guessed[f[j]]
                    guess = True
                else:
                    break
            else:
                if guess:
                    guesses.append((cls, (i, i + k - 1, total)))
                else:
                    longest[cls] = k
                    hits.add(cls, i, i + k - 1, total)
    told = False
    if _CJK.search(sentence):
        # places are in words of mean length, so that windows reach as far as in other languages
        clean = sentence.replace(_MARK, "")
        for first, last, term, cls, edits in lex.in_kana(clean):
            place = n + first / CJK_WORD, n + last / CJK_WORD
            if edits < 0 or (cls == "attack" and edits == 0 and len(clean.strip(_JA_ENDS)) == last - first + 1):
                hits.add(cls, *place, 0)
            elif cls in SUPPORT:
                guesses.append((cls, (*place, edits)))
        told = any(w in clean for w in _saying()[1])
        if told and "」" in clean and "「" in clean:
            hits.quoted |= {n + k / CJK_WORD for k in range(clean.index("「"), clean.rindex("」"))}
    if (hits.by or guesses) and _CALLED.search(sentence):
        hits.add("vocative", n, n, 0)
    # guesses are borne out by what is met, not by each other
    for cls, hit in [g for g in guesses if hits.supported(*g)]:
        hits.add(cls, *hit)
    if hits.by and _MARK in sentence and (told or any(fold(w) in _saying()[0] for w in words)):
        hits.quoted |= _quoted(sentence)
    return hits if hits.by else None


def _reported(h: _Hits, hit) -> float:
    """What is left of a score if others are only told to have said it."""
    return 0.4 if h.near("report", hit, 6) or hit[0] in h.quoted else 1.0


def _eased(h: _Hits, hit, score: float) -> float:
    left = _reported(h, hit)
    score = score if left == 1 else left * min(1.0, score)
    if h.near("goods", hit, 6) or any(o[0] <= hit[1] and hit[0] <= o[1] for o in h.by.get("goods", ())):
        score *= 0.4
    return score - 0.05 * min(2, hit[2])


def judge(h: _Hits) -> tuple[float, float, float]:
    """Scores (abuse, hate, sexual) of a sentence."""
    abuse = hate = sexual = 0.0

    def addressed(x, d: int, side: int = 0) -> bool:
        # a misspelling is less sure, so the one it is meant for stands before it or soon after
        if x[2] and side == 0:
            return h.near("you", x, d, -1) or h.near("you", x, min(d, 3), 1)
        return h.near("you", x, d, side)

    for x in h.by.get("attack", ()):
        abuse = max(abuse, _eased(h, x, 0.95))
    for x in h.by.get("insult", ()):
        s = 0.45 + 0.4 * addressed(x, 6) + 0.35 * h.near("person", x, 8) + 0.3 * h.near("slur", x, 2) + 0.3 * h.near("wish", x, 10) + max(0.3 * h.near("insult", x, 4), 0.2 * h.near("insult", x, 12), 0.2 * h.near("jibe", x, 12)) + 0.25 * h.near("vocative", x, 1)
        if h.near("self", x, 4, -1) and not addressed(x, 4):
            s -= 0.5
        abuse = max(abuse, _eased(h, x, s))
    for x in h.by.get("jibe", ()):
        thrown = h.near("vocative", x, 1) and addressed(x, 10)
        s = 0.15 + 0.5 * addressed(x, 4, -1) + 0.35 * thrown + max(0.3 * h.near("slur", x, 1, -1), 0.2 * h.near("slur", x, 4, 1)) + 0.3 * h.near("person", x, 8) + 0.15 * (addressed(x, 6) or h.near("attack", x, 6))
        if h.near("self", x, 4, -1) and not addressed(x, 3):
            s -= 0.5
        abuse = max(abuse, _eased(h, x, s))
    for x in h.by.get("harm", ()):
        wished = h.near("wish", x, 9, -1)
        s = 0.45 * addressed(x, 3, 1) + 0.35 * (addressed(x, 4, -1) and wished) + 0.4 * wished + 0.2 * (h.near("insult", x, 8) or h.near("jibe", x, 8)) + 0.2 * h.near("person", x, 8)
        if not (addressed(x, 5) or h.near("insult", x, 8) or h.near("person", x, 5)):
            s = min(s, 0.4)
        abuse = max(abuse, _eased(h, x, s))
    for x in h.by.get("blow", ()):
        body = h.near("body", x, 5)
        s = 0.45 * (body and addressed(x, 3)) + 0.3 * h.near("wish", x, 8, -1) + 0.2 * h.near("insult", x, 8)
        s = s if body else min(s, 0.3)
        abuse = max(abuse, _eased(h, x, s + 0.1 * (s > 0.4)))
    # "break you(r) bones" in languages where the one addressed stands between
    for x in h.by.get("body", ()):
        if h.near("blow", x, 4) and addressed(x, 3) and not h.near("goods", x, 4):
            abuse = max(abuse, 0.65 + 0.2 * h.near("wish", x, 9) + 0.1 * h.near("insult", x, 8))
    for x in h.by.get("group", ()):
        s = 0.0
        if h.near("degrade", x, 16):
            s = 0.8
        elif h.near("belittle", x, 8):
            s = 0.3 + 0.35 * (h.near("claim", x, 6))
        elif h.near("harm", x, 8) and h.near("wish", x, 6):
            s = 0.7
        elif h.near("absence", x, 4) and h.near("better", x, 10) and h.near("place", x, 10):
            # a better country without them
            s = 0.8
        hate = max(hate, s * _reported(h, x) - 0.05 * min(2, x[2]))
    for x in h.by.get("explicit", ()):
        s = 0.75 + 0.2 * h.near("offer", x, 10) + 0.1 * (addressed(x, 6) or h.near("person", x, 6))
        sexual = max(sexual, s * _reported(h, x) - 0.05 * min(2, x[2]))
    for x in h.by.get("bodily", ()):
        s = 0.2 + 0.4 * h.near("offer", x, 10) + 0.2 * (h.others("bodily", x, 10) > 0) + 0.3 * h.near("heat", x, 10) + 0.15 * (h.others("heat", x, 10) > 1) + 0.25 * (addressed(x, 4) or h.near("person", x, 4)) + 0.3 * h.near("explicit", x, 12)
        sexual = max(sexual, _eased(h, x, min(s, 1.0)))
    return abuse, hate, sexual


def score_text(text: str | None, lang: str | None = None) -> tuple[float, float, float]:
    """Scores (abuse, hate, sexual) of a text, each from 0 to 1."""
    if not text or not text.strip():
        return 0.0, 0.0, 0.0
    text = repair(text)
    lex = lexicon()
    # quoted words are marked before sentences are cut, since a quotation may hold several
    text = _QUOTED.sub(lambda m: _STARTS.sub(_MARK, m[0]), text.replace(_MARK, ""))
    parts, scoring = [], False
    for s in _SENTENCE.findall(text):
        known = [k for k in map(lex.known, _WORD.findall(s)) if k[0]]
        if known and sum(len(k[0]) == 1 for k in known) >= 3:
            known = [lex.known(w) for w in _join_spelled([k[0] for k in known])]
        counts = any(k[3] for k in known) or lex.begins_kana(s)
        scoring |= counts
        parts.append((s, known, counts))
    if not scoring:
        return 0.0, 0.0, 0.0
    tallies = [_tally(k[1] for k in known) for _, known, _ in parts]
    whole = [sum(t) for t in zip(*tallies)] or [0] * len(FUNCTION_WORDS)
    general = _best(whole, 1) or declared(lang) or list(FUNCTION_WORDS)
    best = [0.0, 0.0, 0.0]
    for (sentence, known, counts), tally in zip(parts, tallies):
        if not counts:
            continue
        own = _best(tally, 2)
        # a sentence without clear signs follows its text, and may be in the declared language
        langs = own if own and (len(own) == 1 or not set(own) & set(general)) else list({*general, *declared(lang), *_best(tally, 1)})
        h = _find([k[0] for k in known], [(i, k[2]) for i, k in enumerate(known) if k[2]], sentence, langs)
        if h is not None:
            for k, s in enumerate(judge(h)):
                best[k] = max(best[k], s)
    return tuple(round(max(0.0, min(1.0, s)), 3) for s in best)


def ordinary_words(docs: DataFrame, share: float = ORDINARY_SHARE, least: int = ORDINARY_LEAST) -> frozenset[str]:
    """Words near a lexicon word that are frequent in the corpus: what to look at when ``INNOCENT`` is extended. No score uses them.

    Counts all documents; only words met as misspellings are counted, combined per batch before the shuffle.
    At most ``words per document / share`` words can pass, so the result is small.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon()
        for b in batches:
            seen: Counter[str] = Counter()
            for text in b["text"].to_pylist():
                if text:
                    seen.update({w.casefold() for w in _words(repair(text)) if lex.misspelt(w)})
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

    texts = spread(docs.select(F.col("text").cast("string")))
    total = docs.count()
    found = texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return frozenset(r.word for r in found.where(F.col("n") >= max(least, share * total)).select("word").collect())


def score(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, source, abuse, hate, sexual, score (the highest) and flagged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [score_text(t, l) for t, l in zip(b["text"].to_pylist(), b["lang"].to_pylist())]
            cols = list(zip(*got)) if got else [(), (), ()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["source"], *[pa.array(c, pa.float64()) for c in cols]], names=["doc_id", "source", "abuse", "hate", "sexual"])

    flat = spread(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"), F.col("lang").cast("string")))
    got = flat.mapInArrow(run, "doc_id long, source string, abuse double, hate double, sexual double")
    return got.withColumn("score", F.greatest("abuse", "hate", "sexual")).withColumn("flagged", F.col("score") >= LIMIT)


def rates(scored: DataFrame) -> DataFrame:
    """Per source: documents, flagged documents and their share, and flagged by category."""
    by = [F.count_if(F.col(c) >= LIMIT).alias(f"{c}_documents") for c in ("abuse", "hate", "sexual")]
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if("flagged").alias("flagged_documents"), *by).withColumn(
        "rate", F.col("flagged_documents") / F.col("documents")
    )
