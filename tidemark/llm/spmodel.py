"""Loading of SentencePiece BPE models, with what the operators on them rest on checked."""

from __future__ import annotations

MARK = "▁"


def mergeable_pieces(path: str) -> dict[str, float]:
    """Score of each piece that merges can make; ValueError for models with other rules.

    Asked for are BPE with byte fallback, no change of the text beforehand but the marks for blanks and the one put
    in front, no user-defined pieces, no piece across a mark that follows another character, and all single
    characters of the pieces as pieces.
    """
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    spec, kinds = model.normalizer_spec, proto.ModelProto.SentencePiece
    if model.trainer_spec.model_type != proto.TrainerSpec.BPE or not model.trainer_spec.byte_fallback:
        raise ValueError("a BPE model with byte fallback is needed")
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
        raise ValueError("a model without text normalization and with a mark put in front is needed")
    if any(p.type == kinds.USER_DEFINED for p in model.pieces):
        raise ValueError("user-defined pieces are not supported")
    pieces = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("pieces cross white-space marks")
    if not {c for p in pieces for c in p} <= pieces.keys():
        raise ValueError("a piece holds a character that is no piece")
    return pieces
