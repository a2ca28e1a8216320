"""Stateless scans and joins on streams, and running statistics.

The batch operators apply as they are: requests carry their messages as an array, so nothing has
to be gathered.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit, chat, identity, retrieval


def judge_requests(stream: DataFrame, service=None) -> DataFrame:
    """Chat verdicts of a stream of requests with a message array."""
    return chat.judge_chat(chat.assemble_messages(stream), service=service)


def inspect_documents(stream: DataFrame) -> DataFrame:
    """The document firewall on a stream of documents."""
    return retrieval.inspect(stream)


def resolve_identities(stream: DataFrame, keys: DataFrame) -> DataFrame:
    """Stream-static join with the key table, which is read anew for every batch."""
    return identity.resolve(stream, keys)


def retrieval_contexts(stream: DataFrame, write):
    """Stream writer that judges whole retrieval requests(request_id, role, team, documents).

    All documents of a request arrive in its row, so each micro-batch is judged on its own.
    `write(entries, batch_id)` must be idempotent per batch, for instance
    `sources.event_tables.append_batch`.
    """
    def judge(batch, batch_id):
        docs = batch.select("request_id", "role", "team",
                            F.posexplode("documents").alias("pos", "d")).select(
            "request_id", "role", "team", "pos", "d.*")
        write(retrieval.document_context(docs), batch_id)

    return stream.writeStream.foreachBatch(judge)


def running_stats(stream: DataFrame) -> DataFrame:
    """Security statistics so far; use output mode complete or update."""
    return stream.agg(*audit.stat_columns())


def windowed_stats(stream: DataFrame, width="5 minutes", lateness="10 minutes",
                   ts="timestamp") -> DataFrame:
    """The same per tumbling window; closed windows are emitted in append mode."""
    return (stream.withWatermark(ts, lateness).groupBy(F.window(ts, width))
            .agg(*audit.stat_columns()))
