"""Token ids of whole texts by a public tokenizer file, one call for every distinct piece of a text part.

The tokenizer cuts a text into runs of letters, single digits and runs of other signs, and never joins
characters across white space. Bytes show these cuts for white space, ASCII and Latin letters alike, so a part's texts
are cut into pieces by array operations, coded by Arrow, and each distinct piece goes straight to
the tokenizer's BPE model. A word with anything else in it (an apostrophe, other alphabets, combining marks, control
characters, the start of a special token) is one piece and goes through the whole tokenizer.
"""

from __future__ import annotations

import struct

import numpy as np

#: Pieces of a generation: those of the last one and this one are remembered, all as one bytes object each.
REMEMBER = 60_000
#: The rules of the tokenizer file for which KINDS below says where a text is cut.
RULES = (r'Sequence(normalizers=[NFC(), Replace(pattern=Regex("\s+"), content=" "), Lowercase()])',
         r"""Sequence(pretokenizers=[Split(pattern=Regex("'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), """
         "behavior=Removed, invert=True), ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])")
SPACE, LETTER, DIGIT, SIGN, ODD = range(5)


def byte_letters() -> dict[int, int]:
    """Byte-level BPE writes each byte as a letter: printable ones as themselves, others from 256 on."""
    out, extra = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[b] = b
        else:
            out[b] = 256 + extra
            extra += 1
    return out


def byte_kinds() -> np.ndarray:
    """Kind of each byte. 0xC3 and a byte that continues it are one of À-ÿ; behind any other first byte, which is
    odd, the kind of the second doesn't matter."""
    kinds = np.full(256, ODD, np.uint8)
    kinds[[9, 10, 11, 12, 13, 32]] = SPACE
    kinds[33:127] = SIGN
    kinds[ord("'")] = ODD
    kinds[48:58] = DIGIT
    for first, last in ((65, 90), (97, 122), (0x80, 0xBF), (0xC3, 0xC3)):
        kinds[first:last + 1] = LETTER
    return kinds


KINDS = byte_kinds()
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def cut_words(raw: np.ndarray, docs: np.ndarray, fine: bool):
    """(kinds, bytes) of the bytes of texts that start at docs[:-1]: letters of plain words in lower case, all of an
    odd word (not fine: of every word) as it is and ODD."""
    if not fine:
        return np.where((raw == 32) | (raw == 10), SPACE, ODD).astype(np.uint8), raw
    kinds, low = KINDS[raw], LOWER[raw]
    latin = np.flatnonzero(raw == 0xC3)
    second = raw[latin + 1]
    kinds[latin[(second == 0x97) | (second == 0xB7)]] = ODD  # the signs among À-ÿ
    low[latin[(second <= 0x9E) & (second != 0x97)] + 1] += 0x20
    angle = np.flatnonzero(raw[:-1] == ord("<"))
    kinds[angle[raw[angle + 1] == ord("|")]] = ODD
    odd = np.flatnonzero(kinds == ODD)
    if len(odd):
        breaks = np.flatnonzero(kinds == SPACE)
        at, doc = np.searchsorted(breaks, odd), np.searchsorted(docs, odd, "right")
        first = np.maximum(np.where(at > 0, breaks[at - 1] + 1, 0) if len(breaks) else 0, docs[doc - 1])
        last = np.minimum(np.append(breaks, len(raw))[at], docs[doc])
        inside = np.zeros(len(raw) + 1, np.int32)
        first, which = np.unique(first, return_index=True)
        inside[first] += 1
        inside[last[which]] -= 1
        word = np.cumsum(inside[:-1]) > 0
        kinds[word], low[word] = ODD, raw[word]
    return kinds, low


class WordIds:
    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.letters = byte_letters()
        # the cuts hold for these rules alone; of any other file, whole words go through the tokenizer
        self.fine = (str(self.tok.normalizer), str(self.tok.pre_tokenizer)) == RULES
        self.last: dict[bytes, bytes] = {}
        self.now: dict[bytes, bytes] = {}

    def piece(self, piece: bytes, kind: int) -> bytes:
        """The ids of a piece, four bytes each."""
        if kind == ODD:
            ids = self.tok.encode(piece.decode(), add_special_tokens=False).ids
        else:
            # ASCII signs and letters stand for themselves
            text = piece.decode() if piece.isascii() else piece.decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.tok.model.tokenize(text)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def look_up(self, pieces: list[bytes], kinds: np.ndarray) -> list[bytes]:
        out = []
        for piece, kind in zip(pieces, kinds.tolist()):
            got = self.now.get(piece)
            if got is None:
                got = self.last.get(piece)
                if got is None:
                    got = self.piece(piece, kind)
                self.now[piece] = got
            out.append(got)
        if len(self.now) > REMEMBER:
            self.last, self.now = self.now, {}
        return out

    def encode(self, texts, end_id: int | None = None):
        """(ids, bounds): text i has ids[bounds[i]:bounds[i + 1]]; end_id, if given, ends each. texts: Arrow strings."""
        import pyarrow as pa
        # large offsets: many texts may hold over 2 GB together
        texts = texts.cast(pa.large_string()).fill_null("")
        _, docs, data = texts.buffers()
        docs = np.frombuffer(docs, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, np.uint8)[docs[0]:docs[-1]] if data else np.zeros(0, np.uint8)
        docs = docs - docs[0]
        ids, ends, of = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(len(docs), np.int64)
        if len(raw):
            kinds, low = cut_words(raw, docs, self.fine)
            cut = np.concatenate([[True], kinds[1:] != kinds[:-1]])
            cut |= kinds == DIGIT
            cut[docs[:-1][docs[:-1] < len(raw)]] = True
            starts = np.flatnonzero(cut)
            full = kinds[starts] != SPACE
            sizes = np.diff(np.append(starts, len(raw)))[full]
            starts = starts[full]
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(low[kinds != SPACE])])
            coded = pieces.dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False)
            kind = np.zeros(len(coded.dictionary), np.uint8)
            kind[code] = kinds[starts]
            of = np.searchsorted(starts, docs)
            found = self.look_up(coded.dictionary.to_pylist(), kind)
            flat = np.frombuffer(b"".join(found), "<u4")
            lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
            first = np.cumsum(lengths) - lengths
            lengths = lengths[code]
            ends = np.concatenate([[0], np.cumsum(lengths)])
            ids = flat[np.repeat(first[code] - ends[:-1], lengths) + np.arange(ends[-1])].astype(np.uint32, copy=False)
        bounds = ends[of]
        if end_id is not None:
            out = np.full(len(ids) + len(texts), end_id, np.uint32)
            spots = np.ones(len(out), bool)
            bounds = bounds + np.arange(len(bounds))
            spots[bounds[1:] - 1] = False
            out[spots] = ids
            ids = out
        return ids, bounds


def token_batches(batches, path: str, end_id: int | None, text_at: int, letters: int = 2_000_000):
    """Arrow batches -> (batch, ids, bounds), joined or cut so that a part holds about `letters` bytes of text
    or one text; the more of them, the fewer pieces are looked up again."""
    import pyarrow as pa
    import pyarrow.compute as pc
    encoder = WordIds(path)
    held, weight = [], 0

    def flush():
        nonlocal held, weight
        part = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held, weight = [], 0
        return part, *encoder.encode(part.column(text_at), end_id)

    for batch in batches:
        sums = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False))
        first = 0
        while first < batch.num_rows:
            base = sums[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(sums, base + letters - weight, "right")))
            held.append(batch.slice(first, last - first))
            weight += int(sums[last - 1] - base)
            first = last
            if weight >= letters or first < batch.num_rows:
                yield flush()
    if held:
        yield flush()
