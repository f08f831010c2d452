"""Landing files as streams: new files become typed rows, events become bars while late ones are still awaited."""

from tidemark.streaming.landing import bars_stream, land, typed_stream

__all__ = ["bars_stream", "land", "typed_stream"]
