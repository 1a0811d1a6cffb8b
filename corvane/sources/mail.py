"""Mail files and nested MIME bodies."""

from __future__ import annotations

import base64
import email
import email.policy
import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType

from corvane.functions.dates import mail_date

HEADERS = {"message_id": "Message-ID", "from_addr": "From", "to_addr": "To", "cc": "Cc", "subject": "Subject", "date": "Date"}
_SCHEMA = "path string, " + ", ".join(f"{h} string" for h in HEADERS) + ", body string"


def parse_mail(content: bytes) -> dict[str, str]:
    """Headers and the text/plain parts of one message, joined; undecodable bytes are replaced."""
    message = email.message_from_bytes(content, policy=email.policy.compat32)
    parts = []
    for part in message.walk():
        if part.get_content_type() == "text/plain" and not part.is_multipart():
            raw = part.get_payload(decode=True) or b""
            parts.append(raw.decode(part.get_content_charset() or "utf-8", "replace") if _known(part.get_content_charset()) else raw.decode("utf-8", "replace"))
    return {k: str(message.get(h) or "") for k, h in HEADERS.items()} | {"body": "\n".join(parts)}


def _known(charset: str | None) -> bool:
    import codecs

    try:
        codecs.lookup(charset or "utf-8")
        return True
    except LookupError:
        return False


def read_maildir(spark: SparkSession, root: str, users: list[str] | None = None, folders: list[str] | None = None, per_user: int | None = None, first_users: int | None = 10, selected: DataFrame | None = None) -> DataFrame:
    """Mails below root/user/folder/, with user_id, folder and parsed_date; the first ``per_user`` of each user by path.

    Without ``users`` those of the first ``first_users`` folders by name, None for all; selected, (user_id) or
    (user_id, folder), chooses by a table instead.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    tail = F.split(F.regexp_replace(F.element_at(F.split("path", re.escape(root.rstrip("/")) + "/"), -1), "^/", ""), "/")
    files = files.withColumns({"user_id": tail[0], "folder": tail[1]})
    if selected is not None:
        files = files.join(selected.select(*(c for c in ("user_id", "folder") if c in selected.columns)).distinct(), [c for c in ("user_id", "folder") if c in selected.columns], "left_semi").select("path", "content", "user_id", "folder")
    elif users is None and first_users is not None:
        files = files.join(F.broadcast(files.select("user_id").distinct().orderBy("user_id").limit(first_users)), "user_id", "left_semi").select("path", "content", "user_id", "folder")
    elif users is not None:
        files = files.where(F.col("user_id").isin(*users))
    if folders is not None:
        files = files.where(F.col("folder").isin(*folders))
    if per_user is not None:
        files = files.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("path"))).where(F.col("rn") <= per_user).drop("rn")

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([{"path": p, **parse_mail(c)} for p, c in zip(pdf["path"], pdf["content"])], columns=["path", *HEADERS, "body"])

    mails = files.select("path", "content").mapInPandas(run, _SCHEMA)
    return mails.join(files.select("path", "user_id", "folder"), "path").withColumn("parsed_date", mail_date("date"))


def body_of_payload(payload: dict) -> str:
    """The longest distinct text among a nested MIME payload's parts, base64url decoded, HTML stripped, white space squeezed."""
    found = []

    def walk(part):
        data = (part.get("body") or {}).get("data")
        kind = part.get("mimeType", "")
        if data and kind in ("text/plain", "text/html"):
            text = base64.urlsafe_b64decode(data + "=" * (-len(data) % 4)).decode("utf-8", "replace")
            if kind == "text/html":
                text = re.sub(r"<[^>]+>", " ", re.sub(r"(?i)</p>", "\n\n", re.sub(r"(?i)<br\s*/?>", "\n", text)))
            found.append(re.sub(r"\s+", " ", text).strip())
        for inner in part.get("parts") or ():
            walk(inner)

    walk(payload)
    return max(dict.fromkeys(found), key=len, default="")


@F.pandas_udf(StringType())
def payload_body(payload: pd.Series) -> pd.Series:
    """``body_of_payload`` of JSON texts; '' if they can't be read."""

    def one(text):
        try:
            return body_of_payload(json.loads(text))
        except (TypeError, ValueError, AttributeError):
            return ""

    return payload.map(one)
