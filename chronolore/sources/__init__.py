"""Readers: chat threads, meeting transcripts, pages, the directory of people, extraction runs and answer keys."""
