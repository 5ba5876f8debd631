"""The machine-event analyses over a Structured Streaming source.

The reference reads its event log whole; nothing in it is incremental.  This
package only lets the *same* operators run on a stream of event documents
(JSON Lines or Parquet files landing in a folder), so a growing log does not
have to be re-read: flattening is stateless (append mode) and the per-machine
OEE keeps one state row per machine (complete mode), bounded by the fleet size.
"""
