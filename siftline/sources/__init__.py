"""Readers and writers: the request log, governed tables, the policy and the signature feed."""
