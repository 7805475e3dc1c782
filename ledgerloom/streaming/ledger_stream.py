"""Append-only ledgers verified as they arrive: a stateful stream keyed by ledger that holds its last digest and length."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerloom.functions import kernel as K

FINDING = "ledger_id string, pos bigint, code string, subject string"
STATE = "pos bigint, record_digest string"


def _verify(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    pos, last = state.get if state.exists else (-1, None)
    found = []
    rows = sorted((r for b in batches for r in b.itertuples(index=False)), key=lambda r: r.pos)
    for r in rows:
        previous = None if pd.isna(r.previous_record_digest) else r.previous_record_digest
        own = K.digest_of({"payloadDigest": r.payload_digest, "previousRecordDigest": previous, "recordId": r.record_id})
        if r.pos <= pos:
            found.append((key[0], r.pos, "ledger-record-mutated", r.record_id))
            continue
        if r.pos == 0 and previous is not None:
            found.append((key[0], r.pos, "ledger-genesis-invalid", r.record_id))
        elif r.pos > 0 and (r.pos != pos + 1 or previous != last):
            found.append((key[0], r.pos, "ledger-chain-broken", r.record_id))
        if r.record_digest != own:
            found.append((key[0], r.pos, "ledger-record-digest-mismatch", r.record_id))
        pos, last = int(r.pos), r.record_digest
    state.update((pos, last))
    yield pd.DataFrame({c: pd.Series([f[i] for f in found], dtype=object) for i, c in enumerate(("ledger_id", "pos", "code", "subject"))})


def verified(stream: DataFrame) -> DataFrame:
    """Findings of a stream of records (ledger_id, pos, record_id, payload_digest, previous_record_digest, record_digest).

    Records of one ledger arrive in order across batches, in any order within one; the state is two values a ledger.
    """
    return stream.groupBy("ledger_id").applyInPandasWithState(_verify, FINDING, STATE, "append", GroupStateTimeout.NoTimeout)
