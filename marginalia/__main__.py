import sys

from marginalia.cli import main

sys.exit(main())
