"""What the driver reads of the stored filters."""

import numpy as np
from helpers import documents

from hazardloom.llm import lm_scoring as lm


def test_filters_are_read_piece_by_piece(spark, monkeypatch):
    texts = [" ".join(f"w{i * j % 997}" for j in range(200)) for i in range(60)]
    model, _ = lm.fit(documents(spark, texts))
    whole = [lm.Filter.join([(r.bucket, r.width, r.bits) for r in s.collect()], model.buckets, 1) for s in model.segments]
    monkeypatch.setattr(lm, "READ_BYTES", 1024)
    kind = type(spark.range(1))
    sizes, plain = [], kind.collect

    def collect(df):
        rows = plain(df)
        sizes.append(sum(len(r.bits) for r in rows if "bits" in df.columns))
        return rows

    monkeypatch.setattr(kind, "collect", collect)
    (part,) = model.parts()
    for got, want in zip(part.filters, whole, strict=True):
        assert (got.bits == want.bits).all() and (got.begins[want.widths > 0] == want.begins[want.widths > 0]).all() and (got.widths == want.widths).all()
    largest = max(int(np.max(f.widths)) // 8 for f in whole)
    assert sum(sizes) == sum(len(f.bits) for f in whole) and max(sizes) <= max(1024, largest)
