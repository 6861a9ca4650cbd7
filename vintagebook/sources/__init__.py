"""Reading publications in, writing and rebuilding the tables made from them."""
