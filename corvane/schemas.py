"""Declared schemas of the tables this engine exchanges."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, MapType, StringType, StructType, TimestampType


def _struct(**fields) -> StructType:
    out = StructType()
    for name, kind in fields.items():
        out = out.add(name, kind())
    return out


TOP_LOGPROBS = StructType().add("token_idx", ArrayType(IntegerType())).add("token_id", ArrayType(IntegerType())).add("logprobs", ArrayType(FloatType())).add("shape", ArrayType(IntegerType()))
MESSAGE = StructType().add("content", StringType()).add("role", StringType()).add("token_ids", ArrayType(IntegerType())).add("top_logprobs", TOP_LOGPROBS)
CONVERSATION = StructType().add("messages", ArrayType(MESSAGE)).add("system_prompt", StringType()).add("metadata", MapType(StringType(), StringType())).add("type", StringType())
#: Sparse log-probabilities in long form.
LOGPROBS = _struct(msg_id=LongType, token_idx=IntegerType, k=IntegerType, token_id=IntegerType, logprob=DoubleType)
TOOL_OUTPUT = _struct(idx=LongType, tool=StringType, success=BooleanType, error=StringType, response=StringType)
EVAL_RESULT = _struct(prompt=StringType, answer=StringType, pred=StringType, convo_id=StringType, sample_idx=IntegerType, num_system_and_user_tokens=LongType, num_assistant_tokens=LongType, score=DoubleType).add("extras", MapType(StringType(), StringType()))
EMAIL = _struct(file_path=StringType, user_id=StringType, folder=StringType, message_id=StringType, from_addr=StringType, to_addr=StringType, cc=StringType, subject=StringType, date=StringType, body=StringType, parsed_date=TimestampType)
CALL_EDGE = _struct(file=StringType, method=StringType, input=StringType, kind=StringType, target_file=StringType, target_method=StringType, arg=StringType, literal=StringType)
EMAIL_MESSAGE = _struct(id=StringType, from_addr=StringType, to_addr=StringType, date=StringType, subject=StringType, body=StringType, snippet=StringType)
THREAD = _struct(id=StringType, label=StringType, date_bucket=StringType, subject=StringType).add("participants", ArrayType(StringType())).add("messages", ArrayType(EMAIL_MESSAGE)).add("content_hash", StringType()).add("last_modified", StringType()).add("thread_size", IntegerType()).add("history_id", StringType())
