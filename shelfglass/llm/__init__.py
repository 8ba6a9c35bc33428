"""Operations on training-data corpora: counts, scans, joins, packing, search and classifiers."""
