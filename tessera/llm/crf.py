"""Linear-chain conditional random field over word-shape features, trained and decoded in numpy batches.

Tokens are runs of letters and digits, and single other characters.  A token's score for a label is the sum of one
table entry per feature; a transition adds one entry per pair of labels.  Chains begin and end in label 0 (outside).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

#: Words that announce a secret, an account, an identity number or a telephone number: the lexicon feature.
KEYWORDS = (
    "access", "accesskey", "accesstoken", "account", "api", "apikey", "auth", "authorization", "authtoken", "bearer", "call", "cell", "credential", "credentials", "fax", "iban", "key", "mobile", "pass", "passphrase", "passwd", "password",
    "phone", "private", "privatekey", "pwd", "secret", "secretkey", "secrets", "security", "social", "ssn", "tel", "telephone", "token", "tokens",
)
#: Tokens after a keyword that still know of it, and tokens before one that it knows of.
REACH = 6
LOOKAHEAD = 2

#: Characters of one text that are decoded at once; a longer one is decoded in windows that give the same labels.
WINDOW_CHARS = 250_000

#: Tokens of a stretch from which it is decoded in blocks.
LONG = 1_024

#: Stands between texts; no text holds it.
_GAP = 0x110000
_GAPS = np.full(REACH, _GAP, np.uint32)
_SIZES = np.asarray([2, 3, 4, 5, 9, 16, 24, 32, 48])
_WORD_REST = re.compile(r"[A-Za-z0-9\x80-\U0010ffff]*")
_BLANKS = np.asarray([*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
_SHAPES = 1 + 7 * (len(_SIZES) + 1) + 94
#: Values of each feature: shapes of the token, of two before and two after it, blanks around it, keyword, keyword near.
WIDTHS = (_SHAPES, _SHAPES, _SHAPES, _SHAPES, _SHAPES, 4, len(KEYWORDS) + 1, len(KEYWORDS) + 1)

_KIND = np.full(256, 2, np.uint8)  # 0 blank, 1 letter or digit, 2 other
_KIND[[c for c in range(128) if chr(c).isalnum()]] = 1
_KIND[128:] = 1
_KIND[[*_BLANKS[_BLANKS < 256], 0]] = 0
_ENDS = {(len(k), k[0], k[-1]) for k in KEYWORDS}
_LOOKUP = np.zeros((16, 128, 128), bool)
for _n, _a, _b in _ENDS:
    for _x in (_a, _a.upper()):
        for _y in (_b, _b.upper()):
            _LOOKUP[_n, ord(_x), ord(_y)] = True


@dataclass
class Tokens:
    """Of several texts together: place of each token, its features, and the number of its text."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    features: np.ndarray


def tokenize(texts: list[str]) -> Tokens:
    """Tokens of all ``texts``; places are code points within each text.  Nothing is seen across texts."""
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    whole = np.concatenate([_GAPS, *(x for c in codes for x in (c, _GAPS))])
    kind = _KIND[np.minimum(whole, 255)]
    if (whole >= 0x1680).any():
        kind[np.isin(whole, _BLANKS)] = 0
    kind[whole == _GAP] = 3
    alnum = kind == 1
    before = np.concatenate([[False], alnum[:-1]])
    start = np.flatnonzero((alnum & ~before) | (kind >= 2))
    word = alnum[start]
    end = start + 1
    end[word] = np.flatnonzero(alnum & ~np.append(alnum[1:], False)) + 1
    low = np.minimum(whole, 127).astype(np.uint8)
    digit, upper = (low >= 48) & (low <= 57), (low >= 65) & (low <= 90)
    hexa = digit | ((low >= 97) & (low <= 102)) | ((low >= 65) & (low <= 70))
    size = end - start
    digits, uppers, hexas = (np.add.reduceat(x & alnum, start, dtype=np.int32) for x in (digit, upper, hexa))
    shape = np.select(
        [digits == size, (digits > 0) & (hexas == size), digits > 0, uppers == 0, (uppers == 1) & upper[start], uppers == size],
        [0, 1, 2, 3, 4, 5], 6,
    ) * (len(_SIZES) + 1) + np.searchsorted(_SIZES, size, side="right") + 1
    shape[~word] = 1 + 7 * (len(_SIZES) + 1) + np.clip(low[start[~word]].astype(np.int64) - 33, 0, 93)
    gap = kind[start] == 3
    shape[gap] = 0
    blank = np.concatenate([[1], (start[1:] > end[:-1]).astype(np.int64), [1]])
    keyword = np.zeros(len(start), np.int64)
    maybe = np.flatnonzero(word & (size < 16))
    maybe = maybe[_LOOKUP[size[maybe], low[start[maybe]], low[end[maybe] - 1]]]
    for i in maybe:
        found = "".join(map(chr, whole[start[i] : end[i]])).lower()
        if found in KEYWORDS:
            keyword[i] = KEYWORDS.index(found) + 1
    near = np.zeros(len(start), np.int64)
    at = np.flatnonzero(keyword)
    for k in range(REACH, 0, -1):
        to = at + k
        near[to[to < len(start)]] = keyword[at[to < len(start)]]
    shifted = lambda k: np.concatenate([np.zeros(max(k, 0), np.int64), shape[max(-k, 0) : len(shape) - max(k, 0)], np.zeros(max(-k, 0), np.int64)])
    features = np.column_stack([shape, shifted(1), shifted(2), shifted(-1), shifted(-2), blank[:-1] * 2 + blank[1:], keyword, near])
    begins = np.cumsum([len(_GAPS), *(len(c) + len(_GAPS) for c in codes)])
    keep = ~gap
    start, end, features = start[keep], end[keep], features[keep]
    text = np.searchsorted(begins, start, side="right") - 1
    return Tokens(start - begins[text], end - begins[text], text, features)


@dataclass
class Crf:
    labels: tuple[str, ...]  # the first is outside
    tables: list[np.ndarray]  # per feature: values x labels
    moves: np.ndarray  # from label x to label

    def scores(self, features: np.ndarray) -> np.ndarray:
        return sum(t[features[..., k]] for k, t in enumerate(self.tables))

    def _open(self, everything: np.ndarray, ends_here: bool = True) -> np.ndarray:
        """Tokens whose label may be another than 0; of all the rest it is certainly 0.

        A run of other labels pays what label 0 leads by at each of its tokens, and wins at most a constant for
        entering and leaving and at each token what the best way into its label is worth.  Where no run through a
        token can win, label 0 is certain.  Where the text goes on after these tokens, a run might leave them too:
        one that does so loses against the same run begun just behind them where its part up to there costs more than
        entering later can.
        """
        stay, into = self.moves[0, 0], self.moves[1:, 1:].max(axis=0)
        enter, leave = self.moves[0, 1:] - into, self.moves[1:, 0].max() - stay
        worth = (everything[:, 1:] + into).max(axis=1) - everything[:, 0] - stay
        total = np.concatenate([[0], np.cumsum(worth)])
        left = total[:-1] - np.minimum.accumulate(total)[:-1]  # most that a run can bring along from before a token
        right = np.maximum.accumulate(total[::-1])[::-1][1:] - total[1:]  # and from after it
        open_ = left + worth + right + enter.max() + leave >= -1e-6
        if not ends_here:
            open_ |= left + worth + total[-1] - total[1:] + np.ptp(enter) >= -1e-6
        return open_

    def _path(self, scores: np.ndarray) -> np.ndarray:
        """Best labels of one long stretch: Viterbi through blocks side by side, each from every label before it, which are then joined."""
        n, width = scores.shape
        side = int(n**0.5)
        blocks = -(-n // side)
        size = np.full(blocks, side)
        size[-1] = n - side * (blocks - 1)
        grid = np.zeros((blocks * side, width))
        grid[:n] = scores
        grid = grid.reshape(blocks, side, width)
        best, back = self.moves + grid[:, :1], []  # from a label before the block to one inside
        for step in range(1, side):
            through = best[..., None] + self.moves
            live = (step < size)[:, None, None]
            back.append(np.where(live, through.argmax(axis=2), np.arange(width)).astype(np.int8))
            best = np.where(live, through.max(axis=2) + grid[:, step, None], best)
        now, joins = best[0, 0], []
        for block in best[1:]:
            through = now[:, None] + block
            joins.append(through.argmax(axis=0))
            now = through.max(axis=0)
        last = np.zeros(blocks + 1, np.int64)  # label before each block, and after the last one's end
        last[-1] = (now + self.moves[:, 0]).argmax()
        for block in range(blocks - 1, 0, -1):
            last[block] = joins[block - 1][last[block + 1]]
        labels, now = np.zeros((blocks, side), np.int64), last[1:]
        for step in range(side - 1, -1, -1):
            labels[:, step] = now
            if step:
                now = back[step - 1][np.arange(blocks), last[:-1], now].astype(np.int64)
        return labels.ravel()[:n]

    def decode(self, tokens: Tokens, everything: np.ndarray | None = None) -> np.ndarray:
        """Best labels of all tokens by Viterbi.

        Chains fall apart at certain tokens; only the stretches between them are decoded, side by side.
        """
        n = len(tokens.start)
        labels = np.zeros(n, np.int64)
        if not n:
            return labels
        if everything is None:
            everything = self.scores(tokens.features)
        open_ = self._open(everything)
        new = open_ & np.concatenate([[True], ~open_[:-1] | (tokens.text[1:] != tokens.text[:-1])])
        first = np.flatnonzero(new)
        if not len(first):
            return labels
        run = np.cumsum(new)[open_] - 1
        size = np.bincount(run)
        for at in np.flatnonzero(size > LONG):
            labels[first[at] : first[at] + size[at]] = self._path(everything[first[at] : first[at] + size[at]])
        first, size = first[size <= LONG], size[size <= LONG]
        if not len(first):
            return labels
        order = np.argsort(-size, kind="stable")
        falling = -size[order]
        places = first[order]
        best = self.moves[0] + everything[places]
        back = []
        for step in range(1, int(size.max())):
            live = np.searchsorted(falling, -step, side="left")  # runs longer than ``step``
            through = best[:live, :, None] + self.moves
            back.append(through.argmax(axis=1).astype(np.int8))
            best[:live] = through.max(axis=1) + everything[places[:live] + step]
        now = (best + self.moves[:, 0]).argmax(axis=1)
        for step in range(int(size.max()) - 1, -1, -1):
            live = np.searchsorted(falling, -step, side="left")
            labels[places[:live] + step] = now[:live]
            if step:
                now[:live] = back[step - 1][np.arange(live), now[:live]]
        return labels

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """Per text: ``(label, start, end)`` of neighbouring tokens of one label, outside ones aside.

        A text of over ``WINDOW_CHARS`` is decoded window by window, with the result of the whole text; memory follows
        the window, the longest word and the longest stretch without a token that is certainly outside.
        """
        short = [t for t in texts if len(t) <= WINDOW_CHARS]
        found = iter(self._spans(short)) if short else iter(())
        return [next(found) if len(t) <= WINDOW_CHARS else self._long_spans(t) for t in texts]

    def _long_spans(self, text: str) -> list[tuple[str, int, int]]:
        """Spans of one text, window by window.

        A window begins ``REACH`` tokens before the first one that is still to be labelled, so that it has its whole
        features, and ends where a word does.  Labels count up to the last token that is certainly outside whatever
        follows; the next window goes on behind it.  Without any such token the window is doubled.
        """
        out: list[tuple[str, int, int]] = []
        begin, first, size = 0, 0, WINDOW_CHARS  # first character and first unlabelled token of the window
        while True:
            to = begin + size
            to = len(text) if to >= len(text) else _WORD_REST.match(text, to).end()
            tokens = tokenize([text[begin:to]])
            whole = to >= len(text)
            upto = len(tokens.start) - (0 if whole else LOOKAHEAD)  # the last ones lack what follows them
            if whole or upto > first:
                part = Tokens(*(x[first:upto] for x in (tokens.start, tokens.end, tokens.text, tokens.features)))
                everything = self.scores(part.features)
                sure = [] if whole else np.flatnonzero(~self._open(everything, ends_here=False))
                if whole or len(sure):
                    n = len(part.start) if whole else int(sure[-1]) + 1
                    part = Tokens(*(x[:n] for x in (part.start, part.end, part.text, part.features)))
                    out += [(kind, a + begin, b + begin) for kind, a, b in self._marked(part, self.decode(part, everything[:n]), 1)[0]]
                    if whole:
                        return out
                    done = first + n
                    first = min(done, REACH)
                    begin, size = begin + int(tokens.start[done - first]), WINDOW_CHARS
                    continue
            size *= 2

    def _spans(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        tokens = tokenize(texts)
        return self._marked(tokens, self.decode(tokens), len(texts))

    def _marked(self, tokens: Tokens, labels: np.ndarray, n: int) -> list[list[tuple[str, int, int]]]:
        out: list[list[tuple[str, int, int]]] = [[] for _ in range(n)]
        marked = np.flatnonzero(labels)
        if len(marked):
            new = np.concatenate([[True], (marked[1:] != marked[:-1] + 1) | (labels[marked[1:]] != labels[marked[:-1]]) | (tokens.text[marked[1:]] != tokens.text[marked[:-1]])])
            starts = np.flatnonzero(new)
            for a, b in zip(marked[starts], marked[np.append(starts[1:], len(marked)) - 1]):
                out[tokens.text[a]].append((self.labels[labels[a]], int(tokens.start[a]), int(tokens.end[b])))
        return out


def likelihood(model: Crf, features: np.ndarray, labels: np.ndarray, sizes: np.ndarray) -> tuple[float, list[np.ndarray], np.ndarray]:
    """Mean log-likelihood of padded chains, and its slopes in tables and moves.  Forward and backward sums are scaled step by step."""
    n, longest, _ = features.shape
    width, rows = len(model.labels), np.arange(n)
    inside = np.arange(longest) < sizes[:, None]
    scores, moves = model.scores(features), model.moves
    top = scores.max(axis=2)
    each, step, leave = np.exp(scores - top[..., None]), np.exp(moves), np.exp(moves[:, 0])
    forward, backward, scale = np.zeros((n, longest, width)), np.zeros((n, longest, width)), np.ones((n, longest))
    now = np.broadcast_to(step[0], (n, width))
    for t in range(longest):
        now = (now if t == 0 else now @ step) * each[:, t]
        scale[:, t] = now.sum(axis=1)
        now = forward[:, t] = now / scale[:, t, None]
    ahead = np.broadcast_to(leave, (n, width))
    for t in range(longest - 1, -1, -1):
        backward[:, t] = ahead = np.where((t + 1 < sizes)[:, None], ahead, leave)
        if t:
            ahead = (each[:, t] * ahead) @ step.T / scale[:, t, None]
    total = np.where(inside, np.log(scale) + top, 0).sum(axis=1) + np.log(forward[rows, sizes - 1] @ leave)
    alone = forward * backward
    alone *= inside[..., None] / alone.sum(axis=2, keepdims=True)
    onward = each[:, 1:] * backward[:, 1:]
    weight = inside[:, 1:] / ((forward[:, :-1] @ step) * onward).sum(axis=2)
    pairs = step * np.einsum("nti,ntj->ij", forward[:, :-1] * weight[..., None], onward, optimize=True)
    true = np.eye(width)[labels] * inside[..., None]
    before = np.concatenate([np.zeros((n, 1), np.int64), labels[:, :-1]], axis=1)
    path = (np.where(inside, scores[rows[:, None], np.arange(longest), labels] + moves[before, labels], 0).sum(axis=1) + moves[labels[rows, sizes - 1], 0] - total).mean()
    rest = (true - alone)[inside] / n
    tables = []
    for k, table in enumerate(model.tables):
        values = features[..., k][inside]
        tables.append(np.column_stack([np.bincount(values, weights=rest[:, y], minlength=len(table)) for y in range(width)]))
    slope = (np.einsum("nti,ntj->ij", true[:, :-1], true[:, 1:], optimize=True) - pairs) / n
    slope[0] += (true[:, 0] - alone[:, 0]).sum(axis=0) / n
    slope[:, 0] += (true[rows, sizes - 1] - alone[rows, sizes - 1]).sum(axis=0) / n
    return float(path), tables, slope


def train(labelled: list[tuple[str, list[tuple[str, int, int]]]], kinds: tuple[str, ...], rounds: int = 120, penalty: float = 5e-4) -> Crf:
    """Fit to texts with ``(kind, start, end)`` spans by full-batch Adam on the penalised likelihood.  Deterministic."""
    model = Crf(("", *kinds), [np.zeros((w, len(kinds) + 1)) for w in WIDTHS], np.zeros((len(kinds) + 1, len(kinds) + 1)))
    chains = []
    for text, spans in labelled:
        tokens = tokenize([text])
        if len(tokens.start):
            y = np.zeros(len(tokens.start), np.int64)
            for kind, start, end in spans:
                y[(tokens.start >= start) & (tokens.end <= end)] = kinds.index(kind) + 1
            chains.append((tokens.features, y))
    if not chains:
        return model
    chains.sort(key=lambda c: len(c[1]))
    groups = []  # chains of like length, padded to the longest of them
    for part in np.array_split(np.arange(len(chains)), min(6, len(chains))):
        sizes = np.asarray([len(chains[i][1]) for i in part])
        features = np.zeros((len(part), sizes.max(), len(WIDTHS)), np.int64)
        labels = np.zeros((len(part), sizes.max()), np.int64)
        for row, i in enumerate(part):
            features[row, : sizes[row]], labels[row, : sizes[row]] = chains[i]
        groups.append((len(part) / len(chains), features, labels, sizes))
    weights = [*model.tables, model.moves]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, rounds + 1):
        slopes = [-penalty * w for w in weights]
        for share, features, labels, sizes in groups:
            _, tables, moves = likelihood(model, features, labels, sizes)
            for slope, g in zip(slopes, [*tables, moves]):
                slope += share * g
        for k, g in enumerate(slopes):
            first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.99 * second[k] + 0.01 * g**2
            weights[k] += 0.15 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return model
