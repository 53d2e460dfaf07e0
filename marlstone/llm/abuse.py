"""Abusive, hateful and sexual content: a score per document, a rate per source.

A document is read in passages. Each passage gives densities of word lists (written ones by
kind, and one whose weights are learned from the labels), how near the words stand to a
second person, shares of capitals and punctuation, and rates of disguised spelling, after the
disguises have been undone. The document's features are the extremes and means over its
passages; gradient-boosted trees score them and an isotonic step makes the score the share of
raters who would object.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.boosting import BoostedTrees, Isotonic

#: Labelled documents that a fit takes at most, chosen by a hash of their id.
MAX_LABELLED = 8_000
#: Score from which a document counts as found where a fit has too little to choose one by.
THRESHOLD = 0.5
#: How much more a wrongly found document weighs in the choice of the cut than in the labelled sample, which holds
#: more objections than the corpus.
HARMLESS_WEIGHT = 4.0
#: Documents that hold a word or pair at least, for it to be learned.
LEAST_DOCUMENTS = 3
WINDOW, STEP = 32, 16

#: Written word lists by kind (English, German, French, Spanish), after undoing disguises; general vocabulary, not taken from any table.
LEXICON = {
    "insult": """idiot idiots moron morons imbecile cretin halfwit dimwit dunce fool fools loser losers pig pigs swine rat rats maggot parasite parasites
        vermin scum filth trash garbage bastard bastards asshole assholes bitch bitches coward clown clowns worm creep jerk douche douchebag dipshit dumbass
        jackass prick twat wanker tosser git scumbag lowlife degenerate freak weirdo dumb stupid pathetic worthless useless disgusting spineless gutless
        brainless ugly repulsive vile despicable contemptible idiota idiotas imbecil imbécil estúpido estúpida tonto basura escoria cerdo asqueroso inútil
        payaso cobarde maldito maldita bastardo cabrón gilipollas idiotin trottel arschloch depp dummkopf blödmann blöd schwein schlampe wichser penner abschaum
        dreck versager widerlich wertlos nutzlos idiote imbécile crétin abruti connard connasse salaud salope ordure pourriture minable débile lâche raclure
        dégoûtant""",
    "threat": """kill kills killing murder die dies dead hang hanged drown choke strangle burn beat beating punch stab shoot shot smash crush break broken
        bash slap hurt harm suffer bleed bury destroy hunt find watch regret warn töten umbringen sterben stirb verrecke schlagen verprügeln brennen hängen
        fertigmachen tuer crever crève mourir meurs frapper brûler pendre tabasser matar muere morir golpear quemar ahorcar paliza romper""",
    "hate": """subhuman subhumans inferior infest infested invaders invasion plague disease cancer animals beasts savages breed breeding breeders deport
        deported exterminate eradicate cleanse purge expel gas race races immigrants migrants foreigners refugees untermenschen ungeziefer ratten parasiten
        ausländer rasse minderwertig vertreiben abschieben ausrotten vermine envahisseurs étrangers race expulser nuisibles sous-hommes plaga ratas
        invasores extranjeros raza expulsar exterminar sucios criminals thieves rapists menschen humans""",
    "sexual": """sex sexy nude nudes naked porn porno xxx horny tits boobs pussy cock dick penis vagina cum cumming orgasm orgasms climax moan moaned moaning
        thighs nipples crotch erection erect lick licked suck sucked blowjob fuck fucked fucking spank spanked rode ride undress undressed strip stripped
        wet dripping thrust thrusting panting escort milf busty cams webcam hottest lust lusty slutty nackt nackte geil geile titten brüste schwanz muschi
        stöhnte stöhnen ficken fickte höhepunkt orgasmus nu nue nus seins sexe bite chatte jouir baise baiser gémit gémissait gémir excité excitée léchait
        desnuda desnudo tetas pechos polla coño follar gemía gemir orgasmo caliente excitada""",
    "profanity": """fuck fucks fucking fucker fucked motherfucker shit shitty bullshit crap piss pissed damn goddamn hell arse ass screw bloody cunt whore
        slut fick ficken scheiße scheiss scheissdreck kacke verdammt hure nutte fresse putain merde foutre bordel pute enculé nique puta puto joder mierda
        coño carajo hostia""",
    "report": """said says say called calls calling wrote write writes quoted quote quotes reported reports report stated lists listed list described
        defined definition word words term terms phrase phrases language comment comments message messages post posts reply email letter poster slogan
        graffiti headline transcript testimony witness victim moderator moderators removed deleted banned flagged forbids prohibits policy rule rules law
        court judge study survey article paper glossary dictionary guide example examples according allegedly accused""",
    "plain": """patient patients clinical medical doctor nurse hospital treatment surgery symptoms diagnosis anatomy tissue infection therapy dose trial
        biology species farm farming veterinary process server program thread bug error engine valve pump machine equipment reproduction health education
        contraception pregnancy breastfeeding examination disorder weak flawed wrong incorrect mistaken unconvincing disagree reject rejected argument
        conclusion evidence""",
    "self": "my mine i me our myself sorry ich mein meine je mon ma yo mi",
}
#: Second-person words in the same languages.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine euch tu toi te ton ta tes vous votre tú ti eres usted vosotros".split())
#: Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans(
    "аАΑαвВΒсСԁеЕΕһнНΗіІΙιјЈкКΚκмМΜΝоОΟοрРΡρѕЅтТΤυνхХΧуУΥΖ",
    "aaaabbbccdeeehhhhiiiijjkkkkmmmnooooppppsstttuvxxxyyyz",
)
#: Digits and signs written for letters.
LEET = str.maketrans("43105789@$!|", "aeiostbgasil")

KINDS = list(LEXICON)
_OF_KIND = {k: frozenset(v.split()) for k, v in LEXICON.items()}
_LISTED = frozenset().union(*_OF_KIND.values()) | SECOND
_MIXED = re.compile("[^\\W\\d_]*[\u0370-\u03ff\u0400-\u052f][^\\W\\d_]*")
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_SPACED = re.compile(r"\b[^\W\d_](?:[ .\-*]{1,2}[^\W\d_](?![^\W_])){2,}")
_LEET = re.compile(r"(?<![A-Za-z0-9@$!|])[A-Za-z@$!|]*[0-9@$][A-Za-z0-9@$!|]*")
_PLAIN_NUMBER = re.compile(r"\d+[A-Za-z]{0,3}|[A-Za-z]\d+|[@$!|0-9]+")
_REPEAT = re.compile(r"([^\W\d_])\1{2,}", re.IGNORECASE)
_MASKED = re.compile(r"(?<![^\W_])([^\W\d_])[*_#•]{1,6}([^\W\d_]*)")
_WORD = re.compile(r"[^\W\d_]+")
_BREAK = re.compile(r"(?<=[.!?…;])[\"'”’)\]]*\s+|[\r\n]+")
DISGUISES = ("script", "hidden", "spaced", "leet", "repeat", "masked")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """What each character is, a bit each: letter, capital, exclamation or question mark, quotation mark, digit or sign
    written for a letter, mask, letter of a script with lookalikes, hidden sign."""
    out = np.array([bool(_WORD.fullmatch(chr(i))) for i in range(0x10000)] + [False]).astype(np.uint8)
    for bit, places in ((2, [*range(65, 91), *range(0xC0, 0xDF)]), (4, map(ord, "!?")), (8, map(ord, "\"“”«»„")), (16, map(ord, "0123456789@$")), (32, map(ord, "*_#•")),
                        (64, range(0x370, 0x530)), (128, [0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF])):
        out[list(places)] |= bit
    return out


def _kinds_of(s: str) -> tuple[np.ndarray, np.ndarray]:
    """Code and class of every character."""
    codes = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return codes, _classes()[np.minimum(codes, 0x10000)]


def undisguise(text: str) -> tuple[str, dict[str, int]]:
    """Text with disguised spellings undone, and how many of each kind there were.

    Each kind is looked for only where its signs stand, since most texts have none.
    """
    return _undisguise(text)[:2]


def _undisguise(text: str) -> tuple[str, dict[str, int], np.ndarray]:
    n = dict.fromkeys(DISGUISES, 0)
    s = text if text.isascii() else unicodedata.normalize("NFKC", text)
    codes, kind = _kinds_of(s)

    def counted(sign: str, pattern: re.Pattern, change):
        nonlocal s, codes, kind

        def one(m: re.Match) -> str:
            out = change(m)
            n[sign] += out != m[0]
            return out

        new = pattern.sub(one, s)
        if new != s:
            s = new
            codes, kind = _kinds_of(s)

    bits = int(np.bitwise_or.reduce(kind)) if len(kind) else 0
    if bits & 64:
        counted("script", _MIXED, lambda m: m[0].translate(LOOKALIKES) if any("a" <= c.lower() <= "z" for c in m[0]) else m[0])
    if bits & 128:
        counted("hidden", _HIDDEN, lambda m: "")
    letter = (kind & 1).astype(bool)
    if len(letter) > 4 and (letter[1:-1] & ~letter[:-2] & ~letter[2:]).sum() + letter[0] + letter[-1] >= 3:
        counted("spaced", _SPACED, lambda m: "".join(c for c in m[0] if c.isalpha()))
    if bits & 16:
        letter, written = (kind & 1).astype(bool), (kind & 16).astype(bool)
        if ((written[1:] & letter[:-1]) | (written[:-1] & letter[1:])).any():
            counted("leet", _LEET, lambda m: m[0] if _PLAIN_NUMBER.fullmatch(m[0]) else m[0].lower().translate(LEET))
    if len(codes) > 2:
        low = codes | 32
        if ((low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & (kind[1:-1] & 1).astype(bool)).any():
            counted("repeat", _REPEAT, lambda m: m[1])
    if bits & 32 and ((kind[1:] & 32).astype(bool) & (kind[:-1] & 1).astype(bool)).any():
        counted("masked", _MASKED, lambda m: f"{m[1]}mask{m[2]}")
    return s, n, kind


class _Numbers(dict):
    """Numbers of words in the order they are met."""

    def __missing__(self, word: str) -> int:
        self[word] = out = len(self)
        return out


#: Per class of character (capitals, marks, quotes) a place in one running sum.
_PACKED = np.array([((i >> 1) & 1) + (((i >> 2) & 1) << 20) + (((i >> 3) & 1) << 40) for i in range(16)], dtype=np.int64)


class Passages:
    """The passages of many texts as flat arrays: sentences and lines, long ones in overlapping windows.

    words: the distinct words; ids: the words of all passages, one after the other; start, size: where each passage's
    ids lie; owner: the text of each passage; up, bang, quote, letters: counts of characters in each.
    """

    def __init__(self, texts: list[str | None]):
        number = _Numbers()
        flat, sizes, owner, counts, disguised = [], [], [], [], []
        for d, text in enumerate(texts):
            if not text:
                disguised.append([0] * len(DISGUISES))
                continue
            s, n, kind = _undisguise(text)
            disguised.append([n[k] for k in DISGUISES])
            letter = np.zeros(len(kind) + 2, dtype=bool)
            letter[1:-1] = kind & 1
            turn = np.nonzero(letter[1:] != letter[:-1])[0]
            first, last = turn[::2], turn[1::2]
            if not len(first):
                continue
            low = s.lower()
            words = _WORD.findall(low)
            if len(words) != len(first):  # letters beyond the table, or whose lower case is longer
                words = [s[i:j].lower() for i, j in zip(first.tolist(), last.tolist())]
            ids = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))
            breaks = np.array([m.start() for m in _BREAK.finditer(s)], dtype=np.int64)
            part = np.searchsorted(breaks, first, side="right")
            at = np.concatenate([[0], np.nonzero(part[1:] != part[:-1])[0] + 1])
            ends = np.append(at[1:], len(ids))
            long = ends - at > WINDOW
            if long.any():
                pairs = list(zip(at[~long].tolist(), ends[~long].tolist()))
                for a, b in zip(at[long].tolist(), ends[long].tolist()):
                    pairs += [(i, min(i + WINDOW, b)) for i in range(a, b - STEP, STEP)]
                pairs.sort()
                at, ends = np.array(pairs).T
                size = ends - at
                inside = np.repeat(at - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
                ids = ids[inside]
            else:
                size = ends - at
            flat.append(ids)
            sizes.append(size)
            owner.append(np.full(len(at), d))
            sums = np.concatenate([[0], np.cumsum(_PACKED[kind & 15])])
            # marks of the end of a sentence belong to it
            stop = np.where(size >= WINDOW, last[ends - 1], np.append(breaks, len(kind))[part[at]].clip(last[ends - 1]))
            packed = sums[stop] - sums[first[at]]
            letters = np.concatenate([[0], np.cumsum(last - first)])
            counts.append(np.stack([packed & 0xFFFFF, (packed >> 20) & 0xFFFFF, packed >> 40, letters[ends] - letters[at]]))
        cat = lambda x, k=np.int64: np.concatenate(x).astype(k) if x else np.array([], dtype=k)
        self.n_texts = len(texts)
        self.words = list(number)
        self.ids, self.size, self.owner = cat(flat), cat(sizes), cat(owner)
        self.start = np.cumsum(self.size) - self.size
        self.up, self.bang, self.quote, self.letters = np.concatenate(counts, axis=1) if counts else np.zeros((4, 0), dtype=np.int64)
        self.disguised = np.array(disguised, dtype=float).reshape(-1, len(DISGUISES))

    def marks(self, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """(passage, mark) of every known word and pair of neighbours."""
        own = np.array([vocabulary.words.get(w, -1) for w in self.words], dtype=np.int64)
        passage = np.repeat(np.arange(len(self.size)), self.size)
        w = own[self.ids] if len(self.ids) else self.ids
        near = passage[1:] == passage[:-1]
        a, b = w[:-1][near], w[1:][near]
        where = passage[:-1][near]
        both = (a >= 0) & (b >= 0)
        pair = vocabulary.pair_marks(a[both], b[both])
        known = pair >= 0
        return np.concatenate([passage[w >= 0], where[both][known]]), np.concatenate([w[w >= 0], pair[known]])


class Vocabulary:
    """Marks: the words and pairs of neighbouring words that enough labelled texts hold."""

    def __init__(self, words: dict[str, int], pairs: np.ndarray):
        self.words, self.pairs, self.base = words, pairs, max(1, len(words))
        self.size = len(words) + len(pairs)

    def pair_marks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a * self.base + b
        if not len(self.pairs):
            return np.full(len(code), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        return np.where(self.pairs[at] == code, at + len(self.words), -1)

    @classmethod
    def of(cls, p: Passages, least: int = LEAST_DOCUMENTS) -> Vocabulary:
        passage = np.repeat(np.arange(len(p.size)), p.size)
        text = p.owner[passage] if len(passage) else passage

        def often(keys: np.ndarray, top: int) -> np.ndarray:
            """The keys (below top) that at least so many texts hold."""
            once = np.unique(text_of * top + keys) % top if len(keys) else keys
            found, n = np.unique(once, return_counts=True)
            return found[n >= least]

        text_of = text
        kept = often(p.ids, max(1, len(p.words)))
        words = {p.words[i]: k for k, i in enumerate(kept.tolist())}
        new = np.full(max(1, len(p.words)), -1, dtype=np.int64)
        new[kept] = np.arange(len(kept))
        w = new[p.ids] if len(p.ids) else p.ids
        near = (passage[1:] == passage[:-1]) & (w[1:] >= 0) & (w[:-1] >= 0)
        codes = w[:-1][near] * max(1, len(words)) + w[1:][near]
        distinct, code_of = np.unique(codes, return_inverse=True)
        text_of = text[:-1][near]
        return cls(words, distinct[often(code_of, max(1, len(distinct)))])


class Bags:
    """The marks of passages as sparse rows: sums over passages and over marks in numpy."""

    def __init__(self, p: Passages, vocabulary: Vocabulary):
        passage, self.mark = p.marks(vocabulary)
        self.width = vocabulary.size
        n = np.bincount(passage, minlength=len(p.size)) if len(p.size) else np.array([], dtype=np.int64)
        self.passage, self.size, self.owner = passage, n, p.owner

    @cached_property
    def text_marks(self) -> np.ndarray:
        """Text and mark as one number, each once; only a fit needs them."""
        return np.unique(self.owner[self.passage] * max(1, self.width) + self.mark)

    def counts(self, weight: np.ndarray) -> np.ndarray:
        """Weighted number of passages with each mark."""
        return np.bincount(self.mark, weight[self.passage], self.width)

    def document_counts(self, weight: np.ndarray) -> np.ndarray:
        """Weighted number of texts with each mark; weight by text."""
        w, found = max(1, self.width), self.text_marks
        return np.bincount(found % w, weight[found // w], self.width)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Sum of the weights of each passage's marks."""
        return np.bincount(self.passage, weights[self.mark], len(self.size))


def _worst(scores: np.ndarray, owner: np.ndarray, n_texts: int) -> np.ndarray:
    """The first passage of the highest score of each text, -1 for a text without passages."""
    top = np.full(n_texts, -np.inf)
    np.maximum.at(top, owner, scores)
    best = np.nonzero(scores == top[owner])[0] if len(owner) else owner
    out = np.full(n_texts, -1)
    out[owner[best][::-1]] = best[::-1]
    return out


def learned_weights(bags: Bags, y: np.ndarray, w: np.ndarray, epochs: int = 60, least: float = 3.0, rate: float = 0.5, ridge: float = 1e-3) -> np.ndarray:
    """Weights of words and pairs, learned by passages; documents of weight 0 are not seen.

    Labels belong to documents, and one passage makes a document objectionable. So a document
    counts by the passage that looks worst at the time, and a logistic fit moves the weights of
    that passage's marks towards the label: the worst passage of a harmless document is just
    what must be told from a foul one. Starts from the log odds of marks over documents, and takes
    marks seen in at least ``least`` documents.
    """
    if not len(bags.owner) or not (y * w).sum() or not ((1 - y) * w).sum():
        return np.zeros(bags.width)
    pos, neg = bags.document_counts(y * w), bags.document_counts((1 - y) * w)
    p_all, n_all = float((y * w).sum()), float(((1 - y) * w).sum())
    use = pos + neg >= least
    odds = np.log((pos + 1) / (neg + n_all / p_all)) + np.log(n_all / p_all)
    weights = np.where(use, np.clip(odds, -3, 3) * (pos + neg) / (pos + neg + 4), 0.0)
    scale = 1 / np.sqrt(np.maximum(1, bags.size))
    seen = w[bags.owner] > 0
    bias, square, bias_square = -2.0, np.full(len(weights), 1e-3), 1e-3
    n_docs = int((w > 0).sum())
    for _ in range(epochs):
        s = np.where(seen, bags.scores(weights) * scale, -np.inf)
        worst = _worst(s, bags.owner, len(y))
        docs = np.nonzero((worst >= 0) & (w > 0))[0]
        at = worst[docs]
        p = 1 / (1 + np.exp(-np.clip(s[at] + bias, -30, 30)))
        g = w[docs] * (y[docs] - p)
        push = np.zeros(len(s))
        push[at] = g * scale[at]
        grad = bags.counts(push) * use - ridge * n_docs * weights
        square += grad * grad
        weights = weights + rate * grad / np.sqrt(square)
        bias_square += g.sum() ** 2
        bias += rate * g.sum() / math.sqrt(bias_square)
    return np.where(np.abs(weights) >= 0.02, weights, 0.0)


def learned_odds(bags: Bags, y: np.ndarray, w: np.ndarray, rounds: int = 3, least: float = 3.0) -> np.ndarray:
    """Log odds of words and pairs between passages that look foul and all passages of other documents.

    The first round counts whole documents; later ones take, of a document with objections, the
    passages that then look worst as the cases.
    """
    weights = np.zeros(bags.width)
    if not len(bags.owner):
        return weights
    a = 0.5
    for turn in range(rounds):
        if turn == 0:
            pos, neg = bags.document_counts(y * w), bags.document_counts((1 - y) * w)
            p_all, n_all = float((y * w).sum()), float(((1 - y) * w).sum())
        else:
            scores = bags.scores(weights)
            top = np.full(len(y), -np.inf)
            np.maximum.at(top, bags.owner, scores)
            best = top[bags.owner]
            chosen = (scores >= best - 1e-9) | (scores > np.maximum(4.0, 0.5 * best))
            case, rest = (y * w)[bags.owner] * chosen, ((1 - y) * w)[bags.owner]
            pos, neg = bags.counts(case), bags.counts(rest)
            p_all, n_all = float(case.sum()), float(rest.sum())
        if not p_all or not n_all:
            return np.zeros(bags.width)
        v = np.log((pos + a) / (p_all + 2 * a)) - np.log((neg + a) / (n_all + 2 * a))
        v *= (pos + neg) / (pos + neg + 4)
        weights = np.where((pos + neg >= least) & (np.abs(v) >= 0.5), np.clip(v, -4, 6), 0.0)
    return weights


FEATURES = [
    *[f"{k}_max" for k in KINDS], *[f"{k}_mean" for k in KINDS], "near_second", "second_max", "caps_max", "caps_mean", "bangs_max", "foul_with_second", "foul_alone", *DISGUISES,
    "learned_1", "learned_2", "learned_3", "learned_gain", "learned_share", "learned_best_mark", "odds_1", "odds_2", "odds_3", "odds_gain", "odds_share",
    "second_at_worst", "insult_at_worst", "report_at_worst", "quotes_at_worst", "words_at_worst", "passages",
]
_FOUL = [KINDS.index(k) for k in ("insult", "threat", "profanity")]
_CALM = [KINDS.index(k) for k in ("report", "plain", "self")]


def _tops(scores: np.ndarray, owner: np.ndarray, n: int, k: int = 3) -> np.ndarray:
    """The k highest scores of each text; a text of fewer passages repeats its lowest."""
    order = np.lexsort((-scores, owner))
    count = np.bincount(owner, minlength=n)
    first = np.cumsum(count) - count
    out = np.zeros((n, k))
    has = count > 0
    for i in range(k):
        out[has, i] = scores[order[first[has] + np.minimum(i, count[has] - 1)]]
    return out


def features(p: Passages, bags: Bags, weights: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """The values of FEATURES of every text; zeros for one without words."""
    n, m = p.n_texts, len(p.size)
    if not m:
        return np.zeros((n, len(FEATURES)))
    own = p.owner
    top = lambda x: np.maximum.reduceat(x, heads)  # noqa: E731  highest value of each text that has passages
    has, heads = np.unique(own, return_index=True)

    def by_text(x: np.ndarray) -> np.ndarray:
        out = np.zeros((n, *x.shape[1:]))
        out[has] = x
        return out

    size = p.size.astype(float)
    member = np.array([[w in _OF_KIND[k] for k in KINDS] for w in p.words], dtype=np.float32) if p.words else np.zeros((0, len(KINDS)))
    second = np.array([w in SECOND for w in p.words])
    hits = np.stack([np.add.reduceat(member[:, k][p.ids], p.start) for k in range(len(KINDS))], axis=1)
    density = hits / size[:, None]
    seconds = np.add.reduceat(second[p.ids].astype(float), p.start)
    words = np.bincount(own, size, n)
    mean = np.stack([np.bincount(own, hits[:, k], n) for k in range(len(KINDS))], axis=1) / np.maximum(1, words)[:, None]
    # how near a foul word stands to a second person in its passage
    passage = np.repeat(np.arange(m), p.size)
    foul_at = np.nonzero(member[:, _FOUL].any(axis=1)[p.ids])[0]
    second_at = np.nonzero(second[p.ids])[0]
    near = np.zeros(m)
    if len(foul_at) and len(second_at):
        right = np.searchsorted(second_at, foul_at)
        for side in (right - 1, right):
            ok = (side >= 0) & (side < len(second_at))
            s = second_at[np.clip(side, 0, len(second_at) - 1)]
            ok &= passage[s] == passage[foul_at]
            np.maximum.at(near, passage[foul_at][ok], 1 / (1 + np.abs(s - foul_at)[ok]))
    foul, calm = hits[:, _FOUL].sum(axis=1) + hits[:, KINDS.index("sexual")], hits[:, _CALM].sum(axis=1)
    caps = np.where(p.letters >= 8, p.up / np.maximum(1, p.letters), 0.0)
    sums, gains, best, odd, odd_gain = bags.scores(weights), bags.scores(np.maximum(weights, 0)), np.zeros(m), bags.scores(odds), bags.scores(np.maximum(odds, 0))
    if len(bags.mark):
        np.maximum.at(best, bags.passage, weights[bags.mark])
    root = np.sqrt(2 * size)
    score = sums / root
    worst = _worst(score, own, n)[has]
    count = np.bincount(own, minlength=n)
    out = np.zeros((n, len(FEATURES)))
    put = {
        **{f"{k}_max": by_text(top(density[:, i])) for i, k in enumerate(KINDS)}, **{f"{k}_mean": mean[:, i] for i, k in enumerate(KINDS)},
        "near_second": by_text(top(near)), "second_max": by_text(top(seconds / size)), "caps_max": by_text(top(caps)),
        "caps_mean": np.bincount(own, p.up, n) / np.maximum(1, np.bincount(own, p.letters, n)), "bangs_max": by_text(top(p.bang / size)),
        "foul_with_second": by_text(top(foul * (seconds > 0))), "foul_alone": by_text(top(foul - calm)),
        **{k: 1000 * p.disguised[:, i] / (50 + words) for i, k in enumerate(DISGUISES)},
        **{f"learned_{i + 1}": x for i, x in enumerate(_tops(score, own, n).T)}, "learned_gain": by_text(top(gains / root)),
        "learned_share": np.bincount(own, score > 1, n) / np.maximum(1, count), "learned_best_mark": by_text(top(best)),
        **{f"odds_{i + 1}": x for i, x in enumerate(_tops(odd, own, n).T)}, "odds_gain": by_text(top(odd_gain)), "odds_share": np.bincount(own, odd > 2, n) / np.maximum(1, count),
        "second_at_worst": by_text((seconds[worst] > 0).astype(float)), "insult_at_worst": by_text(density[worst, KINDS.index("insult")]), "report_at_worst": by_text(density[worst, KINDS.index("report")]),
        "quotes_at_worst": by_text(p.quote[worst].astype(float)), "words_at_worst": by_text(size[worst]), "passages": np.log1p(count),
    }
    for i, k in enumerate(FEATURES):
        out[:, i] = put[k]
    out[count == 0] = 0.0
    return out


@dataclass
class Model:
    vocabulary: Vocabulary
    weights: np.ndarray
    odds: np.ndarray
    trees: BoostedTrees
    calibration: Isotonic
    cut: float
    n_labelled: int

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Share of raters expected to object to each text; null and empty texts score 0."""
        if not len(texts):
            return np.zeros(0)
        p = Passages([t if isinstance(t, str) else None for t in texts])
        x = features(p, Bags(p, self.vocabulary), self.weights, self.odds)
        has = np.bincount(p.owner, minlength=len(texts)) > 0
        return np.where(has, self.calibration(self.trees.margin(x)), 0.0)


def rater_errors(objecting: np.ndarray, raters: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Chance of each document to be objectionable, given its votes: two kinds of documents, each with its own rate of objections."""
    votes = objecting * raters
    q = np.clip(objecting, 0.1, 0.9)
    for _ in range(rounds if len(q) else 0):
        rate = np.clip(((q * votes).sum() + 4.0) / ((q * raters).sum() + 5.0), 0.55, 0.99)
        slip = np.clip((((1 - q) * votes).sum() + 0.5) / (((1 - q) * raters).sum() + 5.0), 0.01, 0.45)
        share = np.clip(q.mean(), 0.01, 0.99)
        logit = np.log(share / (1 - share)) + votes * np.log(rate / slip) + (raters - votes) * np.log((1 - rate) / (1 - slip))
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return q


def choose_cut(scores: np.ndarray, chance: np.ndarray, harmless: float = HARMLESS_WEIGHT) -> float:
    """The score that divides best, by the F measure of found documents against chance, the harmless weighing more.

    scores are those of documents that their own fit did not see; of equal choices the middle of the widest gap counts.
    """
    if not len(scores) or chance.sum() < 1 or (1 - chance).sum() < 1:
        return THRESHOLD
    order = np.argsort(-scores, kind="stable")
    s, q = scores[order], chance[order]
    hit, false = np.cumsum(q), harmless * np.cumsum(1 - q)
    f = 2 * hit / (hit + false + chance.sum())
    last = np.append(s[1:] < s[:-1], True)  # a cut divides unequal scores only
    i = int(np.where(last, f, -1).argmax())
    below = s[i + 1] if i + 1 < len(s) else 0.0
    return float((s[i] + below) / 2)


def fit(texts: list[str], objecting: list[float], raters: list[int], folds: int = 5) -> Model:
    """Model of labelled texts: the share of raters who object, and how many rated each.

    The learned words of a text's features never come from the text itself: they are fitted on
    the other folds, as are the trees whose scores the calibration and the choice of the cut see. Equal texts are in
    one fold.
    """
    y, w = np.array(objecting, dtype=float), np.array(raters, dtype=float)
    p = Passages(texts)
    vocabulary = Vocabulary.of(p)
    bags = Bags(p, vocabulary)
    same = {t: i for i, t in enumerate(dict.fromkeys(texts))}
    fold = (np.random.default_rng(0).permutation(max(1, len(same))) % folds)[[same[t] for t in texts]] if texts else np.array([], dtype=int)
    x = np.zeros((len(texts), len(FEATURES)))
    for k in range(folds):
        seen = np.where(fold != k, w, 0.0)
        mine = fold == k
        if mine.any():
            x[mine] = features(p, bags, learned_weights(bags, y, seen), learned_odds(bags, y, seen))[mine]
    margin = np.zeros(len(texts))
    for k in range(folds):
        rest = fold != k
        if (~rest).any():
            margin[~rest] = BoostedTrees().fit(x[rest], y[rest], w[rest]).margin(x[~rest])
    calibration = Isotonic().fit(margin, y, w)
    # the cut is chosen on margins, which tell apart what the calibration's steps make equal
    cut = choose_cut(margin, rater_errors(y, w))
    level = float(calibration(np.array([cut]))[0]) if len(texts) else THRESHOLD
    return Model(vocabulary, learned_weights(bags, y, w), learned_odds(bags, y, w), BoostedTrees().fit(x, y, w), calibration, level, len(texts))


def labelled(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """doc_id, text, objecting (share of raters whose label is not none), raters.

    Null labels count for nothing, a rater's repeated label once. At most ``most`` documents, those
    with the smallest hash of doc_id.
    """
    per = (
        labels.where("label is not null and doc_id is not null").select("doc_id", "rater", F.lower(F.trim("label")).alias("label")).distinct()
        .groupBy("doc_id").agg(F.avg((F.col("label") != "none").cast("double")).alias("objecting"), F.count(F.lit(1)).cast("int").alias("raters"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    return documents.select("doc_id", "text").where("text is not null").join(per, "doc_id")


def fit_documents(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model:
    """Model fitted on the bounded labelled sample, gathered in the order of doc_id."""
    rows = sorted(labelled(documents, labels, most).collect(), key=lambda r: r["doc_id"])
    return fit([r["text"] for r in rows], [r["objecting"] for r in rows], [r["raters"] for r in rows])


def score_documents(documents: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to keep, and score of every document (whole texts)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(shared.value.score(s.tolist()))

    return documents.select("doc_id", *keep, score.asNondeterministic()("text").alias("score"))


def source_rates(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per source: documents, documents found, their share, mean score."""
    hit = (F.col("score") >= threshold).cast("int")
    return scored.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(hit).alias("n_found"), F.round(F.avg(hit), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score"))
