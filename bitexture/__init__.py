"""bitexture: preparing, tokenizing and evaluating sentence pairs on Spark."""
