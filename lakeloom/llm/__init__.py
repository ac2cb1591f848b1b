"""Operations of a training-data pipeline: classify, dedup, scan, mix, search, encode, extract, archive."""
