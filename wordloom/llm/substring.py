"""Substring dedup by seed and extend: word runs that repeat anywhere in the corpus.

Anchors are winnowed runs of GRAM words; stretches that share an anchor are joined on it and extended
to both sides (see repeats.py), which leaves the maximal repeats of WINDOW words or more. Windows
are judged on the input: all copies lose a repeat, the first one too.

Defined cases: a null or empty text has no words, and fewer than WINDOW words are never removed;
equal texts (of WINDOW words or more) lose all words; repeated rows count as copies; empty tables
give empty results.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, repeats

WINDOW = 35
GRAM = 8


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept has the words that lie in no repeated window, joined by a space."""
    return repeats.with_spans(repeats.keyed(docs, doc_id, text), "words", window, gram).select("doc_id", "text", "spans").mapInArrow(_keep(window, False), "doc_id long, n_words long, n_removed long, kept string")


def _keep(window: int, digest: bool):
    def run(batches):
        for batch in batches:
            n, removed, out = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                w = text.encode("utf-8", "surrogatepass").split()
                kept, at, gone = [], 0, 0
                for b, e in repeats.covered(spans or [], window):
                    kept += w[at:b]
                    gone += e - b
                    at = e
                n.append(len(w))
                removed.append(gone)
                line = b" ".join([*kept, *w[at:]])
                out.append(hashlib.sha256(line).hexdigest() if digest else line.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256" if digest else "kept"])

    return run


def op3_substring_dedup(spark, sf_dir):
    docs = repeats.keyed(common.table(spark, sf_dir, "documents"))
    found = repeats.with_spans(docs, "words", WINDOW, GRAM).select("doc_id", "text", "spans")
    return found.mapInArrow(_keep(WINDOW, True), "doc_id long, n_words long, n_removed long, kept_sha256 string")


ORACLE_SQL = f"""
with d as (select doc_id, row_number() over () as r, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
g as (select r, k, md5(array_to_string(w[k:k + {WINDOW - 1}], ' ')) as h from (select r, w, unnest(range(1, len(w) - {WINDOW - 2})) as k from d where len(w) >= {WINDOW})),
twice as (select r, k from (select r, k, count(*) over (partition by h) as n from g) where n > 1),
gone as (select r, list(distinct p) as ps from (select r, unnest(range(k, k + {WINDOW})) as p from twice) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(len(ps), 0)::bigint as n_removed,
  sha256(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: not list_contains(coalesce(ps, []), i)), lambda i: w[i]), ' ')) as kept_sha256
from d left join gone using (r)
"""
