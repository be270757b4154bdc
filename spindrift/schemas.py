"""Schemas of the frontier's rows; nothing is inferred from data."""

WHERE = "p STRING, v STRING, x STRING"
RESULT = "s INT, d STRING, e STRING, m BIGINT, z STRING, p STRING, v STRING, x STRING"
CURI = f"u STRING, id BIGINT, p STRING, v STRING, x STRING, f INT, w STRUCT<{', '.join(c.replace(' ', ':', 1) for c in WHERE.split(', '))}>, a STRUCT<{', '.join(c.replace(' ', ':', 1) for c in RESULT.split(', '))}>, e BIGINT"
SEEN = "key BIGINT, ts BIGINT"
NEVER = 2**32 - 1
WORKSETS = 256
JOBS = "name STRING, wscl ARRAY<INT>, changed BIGINT"
