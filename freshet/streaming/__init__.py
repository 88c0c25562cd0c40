"""No streaming operators.

Every analysis here works on finished files, so there is no event-time window,
watermark or keyed state to express.  The fifteen-day windows are a fixed
calendar dimension (see ``freshet.functions.dims``), not event-time windows.
"""
