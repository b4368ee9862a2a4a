"""Token counts from a tokenizer compiled to a finite-state transducer.

``Transducer`` reads the normalised bytes of a text. Its states hold what byte-pair
merging can still depend on: the kind of the current pre-token, its longest suffix that
begins some token, and for every position in that suffix the last token of the merge of
what lies before, with its relative token count. Every transition carries the change in
the number of tokens. This is sound because merging has a prefix property (the tokens of a
prefix, without the last, are the tokens of a shorter prefix) and because a sequence of
tokens is the merge of its text exactly when each adjacent pair is. States and transitions
are compiled when a text first needs them, and dropped together when ``STATES`` is reached.

A text runs as chunks of ``CHUNK`` bytes in lock step. A chunk's state map sends an entry
state to an exit state and a count. White space ends every pre-token, so past its first
white space a chunk's map no longer depends on the entry state: it is a constant map, run
from the start state. Composing maps from the left (a prefix scan) then gives each chunk
its entry state, and the bytes before the first white space are run from it. A chunk
without white space gets a map over the states that can reach it: one that the chunk before
leaves when it is run from the start state, then what the maps found so far lead to, until
no state is new (merging forgets what lies far back, so one or two states a chunk are
common). The maps are composed by pointer doubling. Chunks whose maps still grow after
``ROUNDS`` rounds are run one after another, which is exact as well.

Defined cases: null counts as empty; an empty text has 0 tokens; a special string within a
text is one token, as the library has it; ties and repeated rows count alike; texts are read whole
however long they are; an empty table gives an empty result; further columns are not read,
whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from lumenfew.llm.common import append_arrow, table
from lumenfew.llm.packing import VOCABULARY, vocabulary_path
from lumenfew.llm.textvec import per_doc_sum

LIMIT = 2048
CHUNK = 256
#: States kept at most (and twice those that a batch's chunks are in); each takes 1.5 kB.
STATES = 120_000
#: States that a chunk without white space is tried from, at most.
ROUNDS = 12
#: Tokens with a common beginning up to which the tokens before them are told apart only by what they admit.
FEW = 12
SPECIAL = 0xFF
#: What Python lower-cases as the library does, and what is composed already.
_PLAIN = re.compile("[^\x00-ſ]|İ")
START = 0
_CONTRACTIONS = {"s", "t", "m", "d"}
_LONG = {"r": "e", "v": "e", "l": "l"}


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 as it is, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.library = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.split_specials = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        suffix = model["end_of_word_suffix"] or ""
        chars = _byte_chars()

        def known(token: str) -> tuple[bytes, bool]:
            last = bool(suffix) and token.endswith(suffix)
            return bytes(chars[c] for c in (token[: -len(suffix)] if last else token)), last

        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(known(a), known(b)): i for i, (a, b) in enumerate(merges)}
        tokens = {known(t) for t in model["vocab"]}
        self.inner = {b for b, last in tokens if not last}
        self.final = {b for b, last in tokens if last}
        self.begins = {b[:i] for b, _ in tokens for i in range(1, len(b) + 1)}
        self.longest = max(len(b) for b, _ in tokens)
        self.under: dict[bytes, list] = {}  # the tokens that begin so, where they are few
        for token in sorted(tokens):
            for i in range(1, len(token[0]) + 1):
                self.under.setdefault(token[0][:i], []).append(token)
        self.under = {k: v for k, v in self.under.items() if len(v) <= FEW}
        self.kinds: dict[str, str] = {}
        self.reset()

    # -- merging ---------------------------------------------------------------

    def merge(self, symbols: list) -> list:
        """Merge the pair of least rank, leftmost first, until none is left."""
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: self.ranks.get((symbols[i], symbols[i + 1]), 1 << 60))
            pair = symbols[best], symbols[best + 1]
            if pair not in self.ranks:
                break
            symbols[best : best + 2] = [(pair[0][0] + pair[1][0], pair[1][1])]
        return symbols

    def fit(self, before: bytes, token: bytes, last: bool) -> bool:
        """Whether ``token`` may follow the token ``before`` (b"": the beginning)."""
        key = (before, token, last)
        if key not in self.fits:
            whole = before + token
            symbols = [(whole[i : i + 1], last and i == len(whole) - 1) for i in range(len(whole))]
            self.fits[key] = self.merge(symbols) == ([(before, False)] if before else []) + [(token, last)]
        return self.fits[key]

    def stand_in(self, before: bytes, rest: bytes) -> bytes | None:
        """One token for all those that admit the same tokens from ``rest`` on; None if they admit none."""
        if rest not in self.under:
            return before
        key = (before, rest)
        if key not in self.alike:
            admits = tuple(self.fit(before, t, last) for t, last in self.under[rest])
            self.alike[key] = self.stands.setdefault((rest, admits), before) if any(admits) else None
        return self.alike[key]

    #: A core is (suffix, ((last token, count relative to the end), ...)) for each position of the suffix.
    EMPTY = (b"", ((b"", 0),))

    def grow(self, core: tuple, byte: int) -> tuple[tuple, int]:
        suffix, info = core
        text = suffix + bytes([byte])
        for n in range(1, len(text) + 1):
            token = text[-n:]
            if token in self.inner and info[len(text) - n] and self.fit(info[len(text) - n][0], token, False):
                change = info[len(text) - n][1] + 1
                break
        else:
            raise ValueError(f"no token ends {text!r}")
        info = (*(x and (x[0], x[1] - change) for x in info), (token, 0))
        while text and text not in self.begins:
            text, info = text[1:], info[1:]
        # a token can begin only where the rest begins some token that fits what is before
        kept = []
        for i, x in enumerate(info):
            if x and i < len(text):
                before = self.stand_in(x[0], text[i:]) if text[i:] in self.begins else None
                x = None if before is None else (before, x[1])
            kept.append(x)
        while kept[0] is None:
            text, kept = text[1:], kept[1:]
        return (text, tuple(kept)), change

    def finish(self, core: tuple) -> int:
        """The change when the pre-token ends here."""
        suffix, info = core
        for n in range(1, len(suffix) + 1):
            token = suffix[-n:]
            if token in self.final and info[len(suffix) - n] and self.fit(info[len(suffix) - n][0], token, True):
                return info[len(suffix) - n][1] + 1
        raise ValueError(f"no token closes {suffix!r}")

    # -- states ----------------------------------------------------------------

    def reset(self) -> None:
        self.most = STATES
        self.alike: dict[tuple, bytes | None] = {}
        self.stands: dict[tuple, bytes | None] = {}
        self.fits: dict[tuple, bool] = {}
        self.names: list[tuple] = [("start",)]
        self.ids: dict[tuple, int] = {("start",): START}
        self.next = np.full((1024, 256), -1, np.int32)
        self.emit = np.zeros((1024, 256), np.int16)

    def forget(self, held: list[np.ndarray]) -> None:
        """Drop all states but those in ``held``, whose numbers are made anew in place (below 0: none)."""
        kept = np.unique(np.concatenate(held))
        kept = kept[kept >= 0]
        names = [self.names[s] for s in kept.tolist()]
        self.reset()
        anew = np.array([self.number(name) for name in names], np.int64)
        self.most = max(STATES, 2 * len(self.names))
        for states in held:
            live = states >= 0
            states[live] = anew[np.searchsorted(kept, states[live])]

    def number(self, state: tuple) -> int:
        if state not in self.ids:
            self.ids[state] = len(self.names)
            self.names.append(state)
            if len(self.names) > len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.emit = np.concatenate([self.emit, np.zeros_like(self.emit)])
        return self.ids[state]

    def kind(self, char: str) -> str:
        """letter, digit, other or space, as the library's own pre-tokenizer parts the character."""
        if char not in self.kinds:
            parts = lambda s: len(self.library.pre_tokenizer.pre_tokenize_str(s))
            space = self.library.normalizer.normalize_str(char) == " " or not parts(char)
            self.kinds[char] = "space" if space else "letter" if parts("a" + char) == 1 else "other" if parts("!" + char) == 1 else "digit"
        return self.kinds[char]

    def word(self, kind: str, text: bytes, core: tuple | None = None) -> tuple[tuple, int]:
        core, total = core or self.EMPTY, 0
        for b in text:
            core, change = self.grow(core, b)
            total += change
        return (kind, core), total

    def close(self, state: tuple) -> int:
        """The change when the current pre-token, or what hangs on an apostrophe, ends."""
        if state[0] in ("letter", "other"):
            return self.finish(state[1])
        if state[0] == "quote":  # the apostrophe is a pre-token, and so is the letter after it
            return self.whole(b"'") + (self.whole(state[1].encode()) if state[1] else 0)
        return 0

    def whole(self, text: bytes) -> int:
        state, total = self.word("letter", text)
        return total + self.finish(state[1])

    def step(self, state: tuple, char: str) -> tuple[tuple, int]:
        """Read one character."""
        kind, text = self.kind(char), char.encode()
        if state[0] == "quote":
            if not state[1] and char in _CONTRACTIONS:
                return ("start",), self.whole(b"'" + text)
            if not state[1] and char in _LONG:
                return ("quote", char), 0
            if state[1] and _LONG[state[1]] == char:
                return ("start",), self.whole(b"'" + state[1].encode() + text)
            if not state[1] and kind == "other":
                return self.word("other", b"'" + text)
            if state[1] and kind == "letter":
                done = self.whole(b"'")
                state, total = self.word("letter", state[1].encode() + text)
                return state, done + total
        if state[0] == kind and kind in ("letter", "other"):
            return self.word(kind, text, state[1])
        done = self.close(state)
        if kind == "space":
            return ("start",), done
        if kind == "digit":
            return ("start",), done + self.whole(text)
        if char == "'":
            return ("quote", ""), done
        state, total = self.word(kind, text)
        return state, done + total

    def compile(self, state: int, byte: int) -> None:
        name = self.names[state]
        if byte == SPECIAL:
            after, change = ("start",), self.close(name) + 1
        else:
            read = (name[2] if name[0] == "part" else b"") + bytes([byte])
            base = name[1] if name[0] == "part" else name
            needed = 1 if read[0] < 0x80 else 2 if read[0] < 0xE0 else 3 if read[0] < 0xF0 else 4
            after, change = (("part", base, read), 0) if len(read) < needed else self.step(base, read.decode())
        target = self.number(after)
        self.next[state, byte], self.emit[state, byte] = target, change

    # -- texts -----------------------------------------------------------------

    def normalised(self, text: str) -> bytes:
        """The bytes that the transducer reads; special strings become one byte each."""
        parts = self.split_specials.split(text) if self.split_specials and any(s in text for s in self.specials) else [text]
        return bytes([SPECIAL]).join((p.lower() if not _PLAIN.search(p) else self.library.normalizer.normalize_str(p)).encode() for p in parts)

    def march(self, entry: np.ndarray, rows: np.ndarray, held: tuple = ()) -> tuple[np.ndarray, np.ndarray]:
        """Run lanes in lock step; rows: (steps, lanes) bytes. The exit states, and each step's changes.

        ``held`` are arrays of states that the caller goes on with; they are renumbered when states are dropped.
        """
        out = np.empty(rows.shape, np.int16)
        state = entry.astype(np.int64)
        for j in range(len(rows)):
            if len(self.names) > self.most:
                self.forget([state, *held])
            at = state * 256 + rows[j]
            after = self.next.ravel()[at]
            if after.min(initial=0) < 0:
                for k in np.unique(at[after < 0]).tolist():
                    self.compile(k >> 8, k & 255)
                after = self.next.ravel()[at]
            out[j] = self.emit.ravel()[at]
            state = after.astype(np.int64)
        return state, out

    def compose_open(self, grid: np.ndarray, open_: np.ndarray, leave: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit states (written to ``leave``) of chunks without white space by their maps. The chunks so settled, and their counts."""
        lanes = len(grid)
        after_open = np.zeros(lanes, bool)
        after_open[1:] = open_[:-1]
        first = np.flatnonzero(open_ & ~after_open)
        guessed = np.flatnonzero(open_ & np.append(open_[1:], False))
        # a guess begins at a character: the rest of one that began in the chunk before is left out
        split = np.logical_and.accumulate((grid[guessed] & 0xC0) == 0x80, axis=1)
        guess, _ = self.march(np.zeros(len(guessed), np.int64), np.ascontiguousarray(np.where(split, np.uint8(32), grid[guessed]).T), (leave,))
        lane = np.concatenate([first, guessed + 1])
        entry = np.concatenate([np.where(first > 0, leave[first - 1], START), guess])
        chunk, begin, end, count = (np.empty(0, np.int64) for _ in range(4))
        for _ in range(ROUNDS):
            key = np.unique((lane << 32) | entry)
            key = key[~np.isin(key, (chunk << 32) | begin)]
            if not len(key):
                break
            lane, entry = key >> 32, key & 0xFFFFFFFF
            state, made = self.march(entry, np.ascontiguousarray(grid[lane].T), (leave, begin, end, entry))
            chunk, begin, end = np.append(chunk, lane), np.append(begin, entry), np.append(end, state)
            count = np.append(count, made.sum(axis=0, dtype=np.int64))
            goes_on = np.append(open_, False)[lane + 1]
            lane, entry = lane[goes_on] + 1, state[goes_on]
        order = np.argsort((chunk << 32) | begin)
        chunk, begin, end, count = chunk[order], begin[order], end[order], count[order]
        key, none = (chunk << 32) | begin, len(order)
        place = lambda wanted: np.where(np.append(key, -1)[np.searchsorted(key, wanted)] == wanted, np.searchsorted(key, wanted), none)
        jump = np.append(place(((chunk + 1) << 32) | end), none)
        met = np.zeros(none + 1, bool)
        met[place((first << 32) | np.where(first > 0, leave[first - 1], START))] = True
        for _ in range(int(open_.sum()).bit_length()):
            met[jump[met]] = True
            jump = jump[jump]
        met = met[:none]
        leave[chunk[met]] = end[met]
        return chunk[met], count[met]

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        encoded = [self.normalised(t) + b" " for t in texts]
        bounds = np.concatenate([[0], np.cumsum([len(e) for e in encoded])]).astype(np.int64)
        data = np.frombuffer(b"".join(encoded), np.uint8)
        lanes = -(-len(data) // CHUNK)
        grid = np.full(lanes * CHUNK, 32, np.uint8)
        grid[: len(data)] = data
        grid = grid.reshape(lanes, CHUNK)
        space = (grid == 32) | ((grid >= 9) & (grid <= 13))
        open_ = ~space.any(axis=1)
        head = np.where(open_, CHUNK, space.argmax(axis=1) + 1)
        # constant maps: from the start state, with white space in place of the head
        body = np.where(np.arange(CHUNK) < head[:, None], np.uint8(32), grid)
        leave, changes = self.march(np.zeros(lanes, np.int64), np.ascontiguousarray(body.T))
        changes = np.ascontiguousarray(changes.T)
        leave[open_] = -1
        todo = np.arange(lanes)
        if open_.any():
            settled, made = self.compose_open(grid, open_, leave)
            changes[settled, 0] = made  # a chunk without white space lies within one text
            todo = np.setdiff1d(todo, settled)
        enter = np.concatenate([[START], leave[:-1]])
        while len(todo):  # heads whose entry state is known, then those behind them
            ready = todo[enter[todo] >= 0]
            todo = todo[enter[todo] < 0]
            longest = int(head[ready].max())
            rows = np.where(np.arange(longest) < head[ready][:, None], grid[ready, :longest], np.uint8(32))
            state, made = self.march(enter[ready], np.ascontiguousarray(rows.T), (enter, leave))
            changes[ready, :longest] += made.T
            through = ready[open_[ready]]
            leave[through] = state[open_[ready]]
            behind = through[through + 1 < lanes] + 1
            enter[behind] = leave[behind - 1]
        return per_doc_sum(changes.ravel()[: len(data)].astype(np.int64), bounds)


_MACHINES: dict[str, Transducer] = {}


def machine(path: str) -> Transducer:
    """This process's transducer for a vocabulary file."""
    if path not in _MACHINES:
        _MACHINES[path] = Transducer(path)
    return _MACHINES[path]


def with_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``n_bytes, n_tokens, over_limit``."""
    path = path or vocabulary_path(VOCABULARY)

    def run(column):
        texts = [t or "" for t in column.to_pylist()]
        n = machine(path).counts(texts)
        return np.array([len(t.encode()) for t in texts], np.int64), n, n > limit

    return append_arrow(docs, "text", [("n_bytes", "long"), ("n_tokens", "long"), ("over_limit", "boolean")], run, keep)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_counts(table(spark, sf_dir, "documents"), keep=["doc_id"])
