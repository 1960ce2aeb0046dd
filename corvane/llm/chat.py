r"""Chat formatting with cumulative-snapshot collapse.

Chat logs often hold every state of a conversation: after each reply the whole
history is logged again. A conversation whose turns are the first turns of a longer
one is redundant. Each conversation gets the rolling hash of every prefix of its
turns (hash of the turn chained to the hash of the turns before); those whose
last hash is a proper prefix hash of another are removed by an anti-join, and of
equal conversations the one of the smallest id stays. The rest is rendered with
a chat template: "<|role|>\n" text "<|end|>\n" for each turn.

Defined cases: turns go by turn number, then role, then text; rows repeated in
full count once. A null role reads "user", a null text is empty. Turns of a null
conv_id belong to no conversation and are left out. Conversations of empty
texts only are kept. Columns other than the four are ignored. An empty
table gives an empty result.

Scale: one shuffle gathers each conversation in a row (turns are a conversation's
own, so a row is as long as one conversation) and leaves its prefix hashes, 16-byte digests, in a staged table
without texts; they are shuffled once for the anti-join. Turns of the conversations kept are gathered again
and rendered. The chain is SHA-256, so equal hashes are taken
for equal prefixes; it takes time in proportion to the turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import stage, table


def _render(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, turns) to (conv_id, hash of the whole, hashes of its proper prefixes)."""
    for batch in batches:
        ends, proper = [], []
        for turns in batch.column(1).to_pylist():
            h, chain = b"", []
            for t in turns:
                # the role's length keeps the border between role and text
                h = hashlib.sha256(h + f"|{len(t['role'])}|{t['role']}".encode("utf-8", "surrogatepass") + t["text"].encode("utf-8", "surrogatepass")).digest()[:16]
                chain.append(h)
            ends.append(chain.pop())
            proper.append(chain)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends, pa.binary()), pa.array(proper, pa.list_(pa.binary()))], names=["conv_id", "h", "prefixes"])


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, rendered) of each conversation that no other one continues."""
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    whole = lambda df: df.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))
    kind = turns.schema["conv_id"].dataType.simpleString()
    hashed, _ = stage(whole(rows).mapInArrow(_chains, f"conv_id {kind}, h binary, prefixes array<binary>"), "chat")
    first = hashed.groupBy("h").agg(F.min("conv_id").alias("conv_id"))
    proper = hashed.select(F.explode("prefixes").alias("h")).distinct()
    kept = first.join(proper, "h", "left_anti").select("conv_id")
    text = F.array_join(F.transform("turns", _render), "")
    return whole(rows.join(kept, "conv_id", "left_semi")).select("conv_id", F.size("turns").cast("long").alias("n_turns"), text.alias("rendered"))


def op7_chat_snapshots(spark, sf_dir: str) -> DataFrame:
    """Every maximal conversation, rendered."""
    return maximal_conversations(table(spark, sf_dir, "conversations"))


#: In DuckDB: a conversation goes if another one's rendering begins with its own (turns end with a mark of their own).
ORACLE = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, count(*) AS n_turns, string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered,
    min_by(length(role) || ':' || role || text, (turn, role, text)) AS opening
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, rendered FROM c a
WHERE NOT EXISTS (
  SELECT 1 FROM c b WHERE b.opening = a.opening AND b.conv_id <> a.conv_id AND starts_with(b.rendered, a.rendered)
  AND (b.n_turns > a.n_turns OR b.n_turns = a.n_turns AND b.conv_id < a.conv_id))
"""
