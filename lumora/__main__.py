import sys

from lumora.cli import main

sys.exit(main(sys.argv[1:]))
