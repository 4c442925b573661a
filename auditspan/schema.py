"""Table layouts shared by sources, operators and sinks."""

from pyspark.sql import types as T

S, I, L, D, B = (T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(),
                 T.BooleanType())
STRINGS = T.ArrayType(S)


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


CANDIDATE = _struct(
    source=S, rule=S, title=S, message=S, severity=S, cwe=S, owasp=S, category=S,
    file_path=S, line_start=I, line_end=I, code_snippet=S)

FINDING = _struct(
    scan_id=S, finding_id=S, title=S, description=S, severity=S, confidence=D, source=S,
    state=S, cwe=S, owasp=S, category=S, file_path=S, line_start=I, line_end=I,
    code_snippet=S, remediation=S, human_question=S, triage_note=S, triaged_by=S,
    reviewed_by=S, rule=S, endpoint=S, endpoint_id=S, origin=S, raw=S)

FILE = _struct(artifact_id=S, path=S, size_bytes=L, language=S, sha256=S, is_binary=B,
               is_vendored=B, included=B)

ENDPOINT = _struct(
    method=S, path=S, file_path=S, line=I, framework=S, handler=S, auth_hints=STRINGS)

SCAN = _struct(scan_id=S, project_id=S, artifact_id=S, status=S,
               created_at=T.TimestampType())

EVENT = _struct(scan_id=S, seq=L, ts=T.TimestampType(), type=S, stage=S, state=S, done=I,
                total=I, text=S, status=S, control=S, tokens=L)

RESPONSE = _struct(finding_id=S, kind=S, role=S, owner=S, target=S, baseline=B, status=I,
                   length=L, elapsed_ms=L, body_hash=S, error=S, ts=T.TimestampType())

VERDICT = _struct(id=S, verdict=S, confidence=S, reasoning=S, severity=S, human_question=S)

WORK_UNIT = _struct(scan_id=S, phase=S, chunk_key=S)

CONTROL_PATCH = _struct(run_id=S, ts=T.TimestampType(), seq=L, status=S, intercept=S,
                        allow_mutating=B, max_rps=D, exclude_paths=STRINGS)
