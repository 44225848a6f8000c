"""What a Python worker keeps of a vocabulary between tasks and runs."""

from pagespark.llm import bpe


def test_a_worker_keeps_one_encoder_and_decoder(spark, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", {})
    ranks = {bytes([i]): i for i in range(256)}
    again = dict(reversed(ranks.items()))
    first = bpe.Shared(spark, ranks)
    encoder, decoder = bpe._once(bpe.Encoder, first, "."), bpe._once(bpe.Decoder, first)
    same = bpe.Shared(spark, again)  # another run with the same vocabulary goes on with what was remembered
    assert bpe._once(bpe.Encoder, same, ".") is encoder and bpe._once(bpe.Decoder, same) is decoder
    assert bpe._once(bpe.Encoder, same, "..") is not encoder and bpe._once(bpe.Decoder, same) is decoder
    other = bpe.Shared(spark, ranks | {b"ab": 256})
    joined = bpe._once(bpe.Encoder, other, ".")
    assert joined.encode("ab") == bpe.struct.pack("<2i", 97, 98) and joined.transducer.ranks == other.value
    assert [made for _, made in bpe.KEPT.values()] == [joined]  # nothing of the earlier vocabulary stays
