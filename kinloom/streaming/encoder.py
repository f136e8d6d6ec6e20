"""Records written while they stream in (SINK-13, SINK-14): header, records in batches, trailer.

The document is a folder of text parts whose names sort in the order of the document. Batches append; only the states pass through the
driver, never the records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinloom.sources import sinks

INITIAL, HEADER, RECORDS, COMPLETE = "Initial", "HeaderWritten", "RecordsWritten", "Complete"


class EncoderError(RuntimeError):
    """What was asked for does not fit the state; `name` says how."""

    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class StreamEncoder:
    """Writes one document to a folder, in the order header, records, trailer; after a failed write every call raises its error again."""

    def __init__(self, spark: SparkSession, folder: str, ending: str = "\n", preserve_unknown: bool = True):
        self.spark, self.folder, self.ending, self.preserve_unknown = spark, folder, ending, preserve_unknown
        self.state, self.error, self.batches = INITIAL, None, 0

    def _check(self, wrong: dict[str, str]) -> None:
        if self.error:
            raise self.error
        if self.state in wrong:
            raise EncoderError(wrong[self.state])

    def _put(self, rows: DataFrame, name: str) -> None:
        try:
            encoded = sinks.encode(rows, self.ending, self.preserve_unknown).withColumn("text", F.regexp_replace("text", f"{self.ending}$", ""))
            encoded.repartitionByRange("rec_no").sortWithinPartitions("rec_no").select("text").write.mode("overwrite").option("lineSep", self.ending).text(f"{self.folder}/{name}")
        except Exception as error:
            self.error = error
            raise

    def write_header(self, header: DataFrame) -> None:
        """`header` is a HEAD record, as `untyped.header_records` makes it."""
        self._check({HEADER: "header already written", RECORDS: "header already written", COMPLETE: "encoding is complete"})
        self._put(header, "part=0-header")
        self.state = HEADER

    def write_records(self, records: DataFrame, number: int | None = None) -> None:
        """A batch of records in order of rec_no; a batch of the same number replaces the one before."""
        self._check({INITIAL: "header not written", COMPLETE: "encoding is complete"})
        self._put(records, f"part=1-{self.batches if number is None else number:012d}")
        self.state, self.batches = RECORDS, self.batches + 1

    def write_trailer(self) -> None:
        self._check({INITIAL: "header not written", COMPLETE: "trailer already written"})
        try:
            self.spark.createDataFrame([("0 TRLR",)], "text string").coalesce(1).write.mode("overwrite").option("lineSep", self.ending).text(f"{self.folder}/part=2-trailer")
        except Exception as error:
            self.error = error
            raise
        self.state = COMPLETE

    def close(self) -> None:
        if self.error:
            raise self.error
        if self.state != COMPLETE:
            self.error = EncoderError("trailer not written")
            raise self.error

    def drain(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """SINK-14: writes a stream of records batch by batch; reads what is there and stops."""
        return stream.writeStream.foreachBatch(lambda rows, number: self.write_records(rows, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
