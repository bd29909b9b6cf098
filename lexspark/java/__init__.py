"""Java text: a lossless lexer, a tolerant parser, method extraction and structural labels."""
