"""Part of tidewell; see README.md."""
