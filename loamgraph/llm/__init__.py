"""Training-corpus operators. Nothing outside this folder imports it."""
