"""A SentencePiece model rebuilt for the ``tokenizers`` library.

The model file is a protobuf message; only the fields that encoding and decoding
need are read, with a reader of the wire format, so neither the protobuf nor the
sentencepiece package is needed to run.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

SPACE = "▁"
#: Fixed values of the model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    unk_surface: str = " ⁇ "
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    whitespace_as_suffix: bool = False


def _fields(data: bytes):
    """(field number, value) of one message; varints as int, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        if kind not in (1, 2, 5):
            raise ValueError(f"not a SentencePiece model: wire type {kind}")
        size = varint() if kind == 2 else 8 if kind == 1 else 4
        if at + size > len(data):
            raise ValueError("not a SentencePiece model: it ends within a field")
        yield key >> 3, data[at : at + size]
        at += size


def parse_model(data: bytes) -> Model:
    """Read the pieces, trainer settings and normaliser settings of a model file."""
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode("utf-8")
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    m.model_type = v
                elif n == 24:
                    m.whitespace_as_suffix = bool(v)
                elif n == 35:
                    m.byte_fallback = bool(v)
                elif n == 44:
                    m.unk_surface = v.decode("utf-8")
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    m.charsmap = v
                elif n == 3:
                    m.add_dummy_prefix = bool(v)
                elif n == 4:
                    m.remove_extra_whitespaces = bool(v)
                elif n == 5:
                    m.escape_whitespaces = bool(v)
    return m


def _merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Every split of a piece into two pieces, in order of the piece's score."""
    rank = {p: (-s, i) for i, (p, s, kind) in enumerate(pieces) if kind == NORMAL}
    found = []
    for piece, order in rank.items():
        splits = [(piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in rank and piece[i:] in rank]
        found += [(*order, rank[x], rank[y], x, y) for x, y in splits]
    return [(x, y) for *_, x, y in sorted(found)]


def words_are_independent(m: Model) -> bool:
    """Whether a text's ids are those of its words in turn.

    So it is if merges never reach over the end of a word (no piece has a marker
    after another character) and the text isn't changed but for its spaces.
    """
    return (m.model_type == BPE and m.add_dummy_prefix and not m.charsmap and not m.remove_extra_whitespaces
            and not any(kind == USER_DEFINED or kind == NORMAL and SPACE in p.lstrip(SPACE) for p, _, kind in m.pieces))


def build_tokenizer(data: bytes, *, prefix: bool = True) -> Tokenizer:
    """The model as a ``tokenizers.Tokenizer``: normaliser, metaspace marker, scores, byte fallback.

    Unigram and BPE models are supported; word and character models raise
    ``ValueError``, as do models that mark spaces after words or don't escape them.
    Without ``prefix`` the marker before the text's first word is left to the caller.
    """
    m = parse_model(data)
    if m.model_type not in (UNIGRAM, BPE) or m.whitespace_as_suffix or not m.escape_whitespaces:
        raise ValueError("only unigram and BPE models with a marker before each word are supported")
    unk = next((i for i, p in enumerate(m.pieces) if p[2] == UNKNOWN), 0)
    if m.model_type == UNIGRAM:
        low = min(s for _, s, kind in m.pieces if kind == NORMAL) - 10
        vocab = [(p, s if kind in (NORMAL, USER_DEFINED) else low) for p, s, kind in m.pieces]
        model = models.Unigram(vocab, unk_id=unk, byte_fallback=m.byte_fallback)
    else:
        model = models.BPE({p: i for i, (p, _, _) in enumerate(m.pieces)}, _merges(m.pieces), unk_token=m.pieces[unk][0],
                           fuse_unk=True, byte_fallback=m.byte_fallback)
    tok = Tokenizer(model)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend(SPACE)] * (m.add_dummy_prefix and prefix) + [normalizers.Replace(" ", SPACE)]
    tok.normalizer = normalizers.Sequence(steps)
    if words_are_independent(m):
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"), "isolated")
    tail = [decoders.Strip(" ", 1, 0)] if prefix and (m.add_dummy_prefix or m.remove_extra_whitespaces) else []
    tok.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    tok.add_tokens([AddedToken(p, normalized=False) for p, _, kind in m.pieces if kind == USER_DEFINED])
    return tok
