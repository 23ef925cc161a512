"""DataFrame operators over words, lines, movements and statements."""
