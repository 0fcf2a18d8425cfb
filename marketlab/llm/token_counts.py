"""Token counts without token ids: pieces are counted once for each distinct pre-token.

No piece of the vocabulary holds a space mark after another character, so a pre-token (a run of
spaces and the characters up to the next space) is encoded alike wherever it stands, and a text's
count is the sum over its pre-tokens.  First the distinct pre-tokens of all texts are gathered with their frequencies
(summed in each task before they are shuffled), and each is encoded once: a table of pre-tokens and piece counts.  Then
each document's pre-token frequencies are joined to that table.  Its frequent head, ``HEAD`` pre-tokens and ``HEAD_BYTES``
at most, is broadcast and joined where the document is; the rest of the table is joined by pre-token, so what is shuffled is
a document's rare pre-tokens alone, none of which is frequent.  A vocabulary with pieces that cross spaces has no pre-tokens: each text is one.

Null text counts as empty and has no tokens; repeated rows are counted each; very long texts are counted whole; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlab.llm.common import mapped, slices, stored

HEAD, HEAD_BYTES = 300_000, 16_000_000
FLUSH = 200_000
MARK = "▁"
_pre_tokens = re.compile(r" +[^ ]*").findall


def vocabulary(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def space_bound(pieces) -> bool:
    """Whether no piece has a space mark after another character, so that pre-tokens are independent."""
    return not any(MARK in p.lstrip(MARK) for p in pieces)


class Pieces:
    """The library for a model file, and the rule that splits texts into pre-tokens."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.split = space_bound([self.model.id_to_piece(i) for i in range(self.model.get_piece_size())])
        # of a lone last space; encoding the empty rest after it would count nothing
        self.space = len(self.model.encode("a ")) - len(self.model.encode("a"))

    def pre_tokens(self, text: str) -> list[str]:
        """What is encoded by itself: each pre-token without its first space, as the library puts one before a text."""
        if not text:
            return []
        if not self.split:
            return [text]
        if MARK in text:  # the library reads it as a space
            text = text.replace(MARK, " ")
        if text[0] == " " or "  " in text:
            return [p[1:] for p in _pre_tokens(" " + text)]
        return text.split(" ")

    def counts(self, parts: list[str]) -> list[int]:
        """Pieces of each pre-token."""
        return [len(x) if p or not self.split else self.space for p, x in zip(parts, self.model.encode(parts, num_threads=1), strict=True)]


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One library for each worker process."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def pre_token_counts(docs: DataFrame, path: str) -> DataFrame:
    """pre, uses and n: every distinct pre-token of the column text, how often it occurs and its pieces; each is encoded once."""

    def gather(batches):
        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pre", "uses"])
            seen.clear()
            return out

        made, seen = pieces(path), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(made.pre_tokens(text or ""))
                if len(seen) > FLUSH:
                    yield flush()
        yield flush()

    def encode(batches):
        made = pieces(path)
        for batch in (part for whole in batches for part in slices(whole, "pre")):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made.counts(batch.column(0).to_pylist()), pa.int64())], ["pre", "uses", "n"])

    distinct = mapped(docs.select("text"), gather, "pre string, uses long").groupBy("pre").agg(F.sum("uses").alias("uses"))
    return stored(mapped(distinct, encode, "pre string, uses long, n long"), "pre-tokens")


def head_of(table: DataFrame, most: int = HEAD, most_bytes: int = HEAD_BYTES) -> tuple[dict[str, int], int]:
    """The most frequent pre-tokens with their pieces, and the use count above which a pre-token is among them."""
    sizes = table.groupBy("uses").agg(F.count("*").alias("k"), F.sum(F.octet_length("pre")).alias("b")).orderBy(F.desc("uses")).limit(most).collect()
    least, n, size = None, 0, 0
    for r in sizes:
        n, size = n + r.k, size + r.b
        if n > most or size > most_bytes:
            break
        least = r.uses
    if least is None:
        return {}, 1 << 62
    got = table.where(F.col("uses") >= least).select("pre", "n").toArrow()
    return dict(zip(got["pre"].to_pylist(), got["n"].to_pylist(), strict=True)), least


def token_counts(docs: DataFrame, path: str, limit: int, most: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""
    table = pre_token_counts(docs, path)
    head, least = head_of(table, most)
    sent = docs.sparkSession.sparkContext.broadcast(head)

    def run(batches):
        made, head = pieces(path), sent.value
        for batch in (part for whole in batches for part in slices(whole)):
            sizes, known, rest, uses = [], [], [], []
            for text in batch.column("text").to_pylist():
                frequency = Counter(made.pre_tokens(text or ""))
                tail = {p: k for p, k in frequency.items() if p not in head}
                sizes.append(len(text.encode()) if text else 0)
                known.append(sum([head[p] * k for p, k in frequency.items() if p in head]))
                rest.append(list(tail))
                uses.append(list(tail.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(rest, pa.list_(pa.string())), pa.array(uses, pa.list_(pa.int64()))],
                ["doc_id", "n_bytes", "known", "rest", "uses"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    part = mapped(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_bytes long, known long, rest array<string>, uses array<long>")
    part = stored(part.withColumn("row_id", F.monotonically_increasing_id()), "known-counts")
    tail = part.where(F.size("rest") > 0).select("row_id", F.explode(F.arrays_zip("rest", "uses")).alias("x")).select("row_id", F.col("x.rest").alias("pre"), F.col("x.uses").alias("k"))
    tail = tail.join(table.where(F.col("uses") < least).select("pre", "n"), "pre").groupBy("row_id").agg(F.sum(F.col("n") * F.col("k")).alias("tail"))
    total = F.col("known") + F.coalesce("tail", F.lit(0))
    return part.join(tail, "row_id", "left").select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))


def op4_token_counts(docs: DataFrame, path: str | None = None, limit: int = 4096) -> DataFrame:
    """Pieces of every whole text, and whether there are more than ``limit``."""
    return token_counts(docs, path or vocabulary(), limit)
