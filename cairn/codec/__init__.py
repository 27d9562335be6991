"""Bit-stream, Huffman and block colour codecs."""
