"""BPE encoding and decoding as streaming transducers.

**Encoding.** A merge at one place changes tokens further left only through a chain of merges of rising
rank, each ending where the one before began.  ``lookahead`` follows all such chains through the merge
list, from the last rank to the first, and gives the number of bytes after which a token can no longer
change.  The transducer holds at most a block and that lookahead of a word; tokens that end before the
lookahead are stable and leave at once.  What stays behind is encoded anew with the bytes that come,
which gives the same tokens, as any run of tokens of an encoding encodes its own bytes.
Text is read in chunks that end before white space, or inside a run of letters where there is none.

**Decoding.** Ids become bytes, and bytes become text by a state machine that keeps the up to three
bytes of an unfinished character.  Where the tokenizer file names no decoder, its tokens' own spellings
are joined by a space, as the public library does.

Words repeat, so finished words are remembered in a table of bounded size.  Defined results: a null
text is an empty text and has no token.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undercroft.llm.common import text_batches

#: Characters read at a time; bytes of a word held besides the lookahead; words remembered.
CHUNK, BLOCK, REMEMBER = 1 << 16, 256, 400_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 is itself, the others follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


class Merges:
    """A vocabulary and its ordered merges; ``end`` marks the last symbol of a word."""

    def __init__(self, vocab: dict[str, int], merges: list, end: str = "") -> None:
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.vocab, self.end = vocab, end
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(pairs):
            self.rank.setdefault((vocab[a], vocab[b]), (r, vocab[a + b]))
        self.rank_of = {p: r for p, (r, _) in self.rank.items()}
        self.whole = {r: m for r, m in self.rank.values()}
        letters = byte_letters()
        self.symbol = [vocab.get(x) for x in letters]
        self.last = [vocab.get(x + end) for x in letters]
        self.length = {i: max(1, len(t) - (len(end) if end and t.endswith(end) else 0)) for t, i in vocab.items()}

    @cached_property
    def lookahead(self) -> int:
        """Bytes at the end of what was read whose tokens may still change.

        ``reach[x]``: how far left of token x's start a difference there can carry, by merges of later rank than those seen.
        """
        reach: dict[int, int] = {}
        for (a, b), (_, m) in reversed(self.rank.items()):
            from_a, from_m = reach.get(a, 0), reach.get(m, 0)
            reach[b] = max(reach.get(b, 0), self.length[a] + max(from_a, from_m))
            reach[a] = max(from_a, from_m)
        longest = max(self.length.values(), default=1)
        return max(reach.values(), default=0) + longest

    def merged(self, ids: list[int]) -> list[int]:
        """All merges of a bounded run of symbols, lowest rank first, leftmost first."""
        get, whole = self.rank_of.get, self.whole
        ranks = [get((a, b), NEVER) for a, b in zip(ids, ids[1:])]
        while ranks and (r := min(ranks)) != NEVER:
            i = ranks.index(r)
            ids[i:i + 2] = whole[r],
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), NEVER)
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), NEVER)
        return ids


NEVER = 1 << 60


class Transducer:
    """One word, fed in parts; ``push`` and ``finish`` give the tokens that are stable."""

    def __init__(self, merges: Merges) -> None:
        self.merges, self.held = merges, bytearray()

    def push(self, data: bytes) -> Iterator[int]:
        for at in range(0, len(data), BLOCK):
            self.held += data[at:at + BLOCK]
            yield from self.stable()

    def stable(self) -> Iterator[int]:
        m = self.merges
        if len(self.held) <= m.lookahead + BLOCK:
            return
        done, limit = 0, len(self.held) - 1 - m.lookahead  # the last byte waits: it may end the word
        for token in m.merged([m.symbol[b] for b in self.held[:-1]]):
            if done + m.length[token] > limit:
                break
            done += m.length[token]
            yield token
        del self.held[:done]

    def whole(self, data: bytes) -> list[int]:
        """A word, or the rest of one, that ends here and is no longer than what the transducer holds."""
        ids = [self.merges.symbol[b] for b in data]
        if data:
            ids[-1] = self.merges.last[data[-1]]
        return self.merges.merged(ids)

    def finish(self) -> list[int]:
        data, self.held = self.held, bytearray()
        return self.whole(data)


class Codec:
    """A tokenizer file: normal form, splitting pattern, merges, special tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.merges = Merges(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.byte_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        normal = json.dumps(spec.get("normalizer"))
        self.nfc, self.lower, self.fold = '"NFC"' in normal, '"Lowercase"' in normal, '"Replace"' in normal
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # \s of the file's expression engine is the White_Space property
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}"), regex.V0)
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.digits = {i: str(i) for i in self.names}
        self.words: dict[str, tuple[tuple[int, ...], str, str]] = {}

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower() if self.lower else text
        if self.nfc:
            text = unicodedata.normalize("NFC", text)
        if self.lower:  # letter by letter: a final sigma is a sigma
            text = text.replace("Σ", "σ").lower()
        return text

    def chunks(self, text: str) -> Iterator[tuple[str, bool]]:
        """Parts of a text and whether a run of letters goes on in the next."""
        at, n = 0, len(text)
        while at < n:
            end = at + CHUNK
            if end >= n:
                yield text[at:], False
                return
            cut = next((i for i in range(end, max(at, end - 4096), -1) if text[i].isspace() and not text[i - 1].isspace()), None)
            if cut is None:  # no white space near: four plain letters in a row can be parted anywhere after the third
                run = next((i for i in range(end, max(at + 3, end - 4096), -1) if text[i - 3:i + 1].isascii() and text[i - 3:i + 1].isalpha()), None)
                if run is not None:
                    yield text[at:run], True
                    at = run
                    continue
                while end < n and not (text[end].isspace() and not text[end - 1].isspace()):
                    end += 1
                cut = end
            yield text[at:cut], False
            at = cut

    def word(self, word: str) -> tuple[tuple[int, ...], str, str]:
        """Ids of a whole word, written with blanks, and their decoded spelling."""
        t = Transducer(self.merges)
        data = word.encode("utf-8", "replace")
        ids = (*t.push(data), *t.finish()) if len(data) > BLOCK else tuple(t.whole(data))
        made = (ids, " ".join([self.digits[i] for i in ids]), self.decode(ids))
        if len(word) <= 64:
            if len(self.words) >= REMEMBER:
                self.words.clear()
            self.words[word] = made
        return made

    def stream(self, text: str) -> Iterator[tuple[tuple[int, ...], str, str]]:
        """Tokens as they become stable, by word."""
        known, findall = self.words, self.pattern.findall
        at = 0
        spots = [*self.cut.finditer(text)] if self.cut and "<|" in text else []
        for spot in [*spots, None]:
            part = text[at:spot.start() if spot else len(text)]
            opened: Transducer | None = None
            for chunk, goes_on in self.chunks(part):
                found = findall(self.normal(chunk))
                if opened is not None and found:
                    yield self.rendered(opened.push(found[0].encode()))
                    if len(found) > 1 or not goes_on:
                        yield self.rendered(opened.finish())
                        opened = None
                    del found[0]
                last = found.pop() if goes_on and found else None
                for w in found:
                    yield known.get(w) or self.word(w)
                if last is not None:
                    opened = Transducer(self.merges)
                    yield self.rendered(opened.push(last.encode()))
            if opened is not None:
                yield self.rendered(opened.finish())
            if spot:
                yield self.rendered([self.special[spot.group()]])
                at = spot.end()

    def rendered(self, ids) -> tuple[tuple[int, ...], str, str]:
        ids = tuple(ids)
        return ids, " ".join(map(str, ids)), self.decode(ids)

    def encode(self, text: str | None) -> list[int]:
        return [i for ids, _, _ in self.stream(text or "") for i in ids]

    def decode(self, ids) -> str:
        if not self.byte_decoder:
            return " ".join(self.names[i] for i in ids)
        machine = Bytes()
        return "".join(map(machine.feed, self.spelled(ids))) + machine.end()

    def spelled(self, ids, word_end: str = "") -> Iterator[bytes]:
        """The bytes of each token; ``word_end`` is put after a token that ends a word."""
        back = {c: b for b, c in enumerate(byte_letters())}
        special = set(self.special.values())
        for i in ids:
            name, end = self.names[i], self.merges.end
            if i in special:
                yield name.encode()
                continue
            ends = bool(end) and name.endswith(end)
            yield bytes(back[c] for c in (name[: -len(end)] if ends else name)) + (word_end.encode() if ends else b"")

    def decode_text(self, ids, word_end: str = " ") -> str:
        """Readable text: bytes of the tokens, with ``word_end`` after each word."""
        machine = Bytes()
        return "".join(map(machine.feed, self.spelled(ids, word_end))) + machine.end()


class Bytes:
    """UTF-8 to text, byte by byte: the state is the unfinished character, at most three bytes."""

    def __init__(self) -> None:
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        keep = 0
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead >= 0xC0:  # a leading byte: does its character need more bytes than are here?
                keep = back if back < (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4) else 0
                break
            if lead < 0x80:
                break
        self.held = data[len(data) - keep:]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def end(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


def digests(text: str | None, codec: Codec, keep: list[int] | None = None) -> tuple[int, str, str]:
    """Number of tokens, SHA-256 of the ids and of the decoded text, both written as they come; ids are added to ``keep``."""
    n, ids_hash, text_hash, first = 0, hashlib.sha256(), hashlib.sha256(), True
    ids_out, text_out = [], []
    for ids, written, spelled in codec.stream(text or ""):
        if not ids:
            continue
        n += len(ids)
        if keep is not None:
            keep += ids
        ids_out.append(written)
        text_out.append(spelled)
        if len(ids_out) >= 8192:
            lead = "" if first else " "
            ids_hash.update((lead + " ".join(ids_out)).encode())
            text_hash.update((lead * (not codec.byte_decoder) + (" " * (not codec.byte_decoder)).join(text_out)).encode())
            ids_out, text_out, first = [], [], False
    lead = "" if first or not ids_out else " "
    ids_hash.update((lead + " ".join(ids_out)).encode())
    text_hash.update((lead * (not codec.byte_decoder) + (" " * (not codec.byte_decoder)).join(text_out)).encode())
    return n, ids_hash.hexdigest(), text_hash.hexdigest()


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Id, ``n_tokens, ids_sha256, decoded_sha256``, and ``ids`` if asked for.

    ``vocabulary`` is the path of the tokenizer file on every executor.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary)
        for whole in batches:
            for b in text_batches([whole], "text"):
                texts = b.column("text").to_pylist()
                tokens: list = [[] for _ in texts] if with_ids else [None] * len(texts)
                n, ids, out = zip(*(digests(t, codec, k) for t, k in zip(texts, tokens, strict=True)), strict=True)
                columns = [b.column("id__"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(out, pa.string())]
                if with_ids:
                    columns.append(pa.array(tokens, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=["id__", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    out = docs.select(F.col(id_col).alias("id__"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id__ {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("id__", id_col)
