"""An extension: redaction of a stream of documents, batch by batch, with a vault read as it stands at each batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.redact import redact
from ..rules import Lineage, Policy
from ..sources.tables import scratch


def redact_stream(docs: DataFrame, path: str, checkpoint: str, roster: Callable[[], DataFrame] | None = None, vault: Callable[[], DataFrame] | None = None, policy: Policy | None = None, lineage: Lineage | None = None) -> StreamingQuery:
    """Writes texts without residue to path/texts and manifests to path/manifest, a folder for each batch; a batch that runs
    again after a failure replaces its own."""

    def one(batch: DataFrame, number: int) -> None:
        with scratch(batch.sparkSession):
            out = redact(batch, roster and roster(), vault and vault(), policy, lineage)
            kept = out.documents.select("record_id", "redacted").join(out.manifest.where("NOT withheld").select("record_id"), "record_id")
            kept.write.parquet(f"{path}/texts/batch={number}", mode="overwrite")
            out.manifest.write.json(f"{path}/manifest/batch={number}", mode="overwrite")

    return docs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
